"""The corpus pipeline: documents in, packed training sequences out.

Each stage reads the Parquet that the stage before has written.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlake.llm import jaccard, mixing, packing, pii, quality_rules
from trendlake.llm.tables import parts_for
from trendlake.session import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row judged by its own text and its host, with an id or without."""
    return quality_rules.kept_rows(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts with 0.8 of their five-word shingles in common.

    Rows are told apart by their place in the files, so rows without an id or
    with the id of another text are judged like any other. The first row of a
    group stays; rows without a word are no one's copy and stay.
    """
    rows = jaccard.numbered(docs.select(*COLUMNS))
    linked = jaccard.linked_rows(rows.select("_row", F.col("doc_id").cast("long").alias("_key"), "text"), size=5, percent=80)
    gone = linked.filter("component < _row").select("_row")
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS).coalesce(parts_for(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets."""
    return pii.mask_personal(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in global random order."""
    return mixing.mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).coalesce(parts_for(docs))


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: Token ids, regular-expression positions and Poisson draws chained through files: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/trendlake/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
