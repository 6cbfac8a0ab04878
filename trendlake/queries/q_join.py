"""Join, sort, limit and set queries."""

from pyspark.sql import functions as F

from trendlake.functions.lists import parse_list_json
from trendlake.operators import joins as J
from trendlake.queries.base import LITERAL_SQL, SPACE_SQL, TRACK_SQL, literals, query, r, space, table, tracks


@query("fan_out_join", f"""
WITH {LITERAL_SQL}
SELECT id, p_type, unnest(string_split(replace(replace(replace(genres, '[', ''), ']', ''), '''', ''), ', ')) AS artist FROM literals""")
def fan_out_join(spark, d):
    t = literals(spark, d).select("id", "p_type", parse_list_json("genres").alias("artists"))
    return J.explode_items(t, "artists", "artist")


@query("two_dataset_join", """
SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)""")
def two_dataset_join(spark, d):
    return table(spark, d, "documents", "doc_id", "lang").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id")


@query("multi_key_join", """
WITH a AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL),
     b AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS top FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, n, top FROM a JOIN b USING (l_orderkey, l_linenumber)""")
def multi_key_join(spark, d):
    keys = ["l_orderkey", "l_linenumber"]
    g = J.spread_by_key(table(spark, d, "lineitem", *keys, "l_quantity"), keys).groupBy(*keys)
    return g.agg(F.count("*").alias("n")).join(g.agg(F.max("l_quantity").alias("top")), ["l_orderkey", "l_linenumber"])


@query("keyed_features_and_scores", f"""
WITH {SPACE_SQL} SELECT vec_id, prediction, round(x, 6) AS pc1 FROM space""")
def keyed_features_and_scores(spark, d):
    # Keys travel with the scores, so no positional join is needed.
    return space(spark, d).select("vec_id", "prediction", r(F.get("score", F.lit(0))).alias("pc1"))


@query("centre_join_back", f"""
WITH {TRACK_SQL}, c AS (SELECT year, artist, avg(p) AS cp FROM tracks GROUP BY year, artist)
SELECT year, artist, count(*) AS n, round(avg(abs(p - cp)), 6) AS gap FROM tracks JOIN c USING (year, artist) GROUP BY year, artist""")
def centre_join_back(spark, d):
    t = tracks(spark, d)
    c = t.groupBy("year", "artist").agg(F.avg("p").alias("cp"))
    return t.join(c, ["year", "artist"]).groupBy("year", "artist").agg(
        F.count("*").alias("n"), r(F.avg(F.abs(F.col("p") - F.col("cp"))), 6).alias("gap"))


@query("labels_onto_all_rows", """
SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)""")
def labels_onto_all_rows(spark, d):
    return J.label_all(table(spark, d, "documents", "doc_id"), table(spark, d, "labels"), "doc_id", ["quality"])


@query("anti_join", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def anti_join(spark, d):
    return table(spark, d, "documents", "doc_id").join(table(spark, d, "labels", "doc_id"), "doc_id", "left_anti")


@query("sampled_member_rows")
def sampled_member_rows(spark, d):
    return J.sampled_members(tracks(spark, d).select("artist", "year", "name"), "artist", 0.3, 7)


@query("semi_join", """
SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def semi_join(spark, d):
    good = table(spark, d, "labels").filter("quality = 1")
    return table(spark, d, "documents", "doc_id", "lang").join(good, "doc_id", "left_semi")


@query("relabel_map", """
WITH m AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS new_label FROM (SELECT DISTINCT label FROM embeddings))
SELECT vec_id, CAST(new_label AS INTEGER) AS label FROM embeddings JOIN m USING (label)""")
def relabel_map(spark, d):
    # Labels with gaps between them.
    e = table(spark, d, "embeddings").select("vec_id", (F.col("label") * 3 + 1).alias("label"))
    return J.relabel(e, J.dense_labels(e, "label"), "label").withColumn("label", F.col("label").cast("int"))


@query("dense_relabel", """
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS new_label
FROM (SELECT DISTINCT label * 3 + 1 AS label FROM embeddings)""")
def dense_relabel(spark, d):
    e = table(spark, d, "embeddings").select((F.col("label") * 3 + 1).alias("label"))
    return J.dense_labels(e, "label").withColumn(
        "new_label", F.col("new_label").cast("int"))


@query("release_date_lookup", """
SELECT l_orderkey, l_linenumber, strftime(o_orderdate, '%Y-%m-%d') AS release_date
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def release_date_lookup(spark, d):
    dates = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"))
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber").join(dates, "l_orderkey", "left")


@query("top_rows_per_cluster", """
SELECT label, vec_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings)
WHERE rank <= 10""")
def top_rows_per_cluster(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).alias("score"))
    return J.top_per_group(e, "label", [F.desc("score"), F.asc("vec_id")], 10).select("label", "vec_id", "rank")


@query("sorted_by_date", """
SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem ORDER BY l_shipdate""")
def sorted_by_date(spark, d):
    t = table(spark, d, "lineitem").orderBy("l_shipdate")
    return t.select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))


@query("largest_by_column", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def largest_by_column(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("union_of_frames", """
SELECT kind, count(*) AS n FROM (SELECT 'doc' AS kind FROM documents UNION ALL SELECT 'page' FROM pages) GROUP BY kind""")
def union_of_frames(spark, d):
    docs = table(spark, d, "documents").select(F.lit("doc").alias("kind"))
    pages = table(spark, d, "pages").select(F.lit("page").alias("kind"))
    return docs.unionByName(pages).groupBy("kind").agg(F.count("*").alias("n"))


@query("distinct_pairs", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_pairs(spark, d):
    return table(spark, d, "lineitem", "l_suppkey", "l_returnflag").distinct()
