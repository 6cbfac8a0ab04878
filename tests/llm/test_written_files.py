"""Tables in between are written in as many files as their size asks for, whatever the number of shuffle partitions."""

import numpy as np

from trendlake import session
from trendlake.llm import jaccard, tables
from trendlake.operators import components

MANY = 61
SETTINGS = {"spark.sql.shuffle.partitions": str(MANY), "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def test_small_tables_of_many_partitions_go_to_few_files(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(80):
        own = rng.integers(0, 5000, 40).tolist()
        texts += [" ".join(map(str, own)), " ".join(map(str, [*own, "x"])), " ".join(map(str, [*own, "y"]))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for module in (jaccard, components):
        monkeypatch.setattr(module, "discard", lambda *_: None)
    for module in (session, tables):
        monkeypatch.setattr(module, "shared_folder", lambda _: f"{tmp_path}/shared")
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        rows = docs.select(docs.doc_id.alias("_row"), docs.doc_id.alias("_key"), "text")
        found = {r["_row"]: r["component"] for r in jaccard.linked_rows(rows, size=3, percent=80).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert found == {i: i // 3 * 3 for i in range(len(texts))}
    files = [len(list(d.glob("part-*"))) for d in (tmp_path / "shared/trendlake").iterdir()]
    assert len(files) > 20 and max(files) <= spark.sparkContext.defaultParallelism < MANY


def test_large_tables_keep_their_partitions(spark, tmp_path):
    spark.range(600_000).selectExpr("id", "uuid() AS name").write.parquet(f"{tmp_path}/large")
    large = spark.read.parquet(f"{tmp_path}/large")
    size = sum(p.stat().st_size for p in (tmp_path / "large").glob("part-*"))
    assert tables.parts_for(large) == max(-(-size // 2**21), spark.sparkContext.defaultParallelism) > 4
    assert large.repartition(4).coalesce(tables.parts_for(large)).rdd.getNumPartitions() == 4
