"""Profiling queries."""

from pyspark.sql import functions as F

from trendlake.operators import profile as P
from trendlake.queries.base import FEATURES, TRACK_SQL, query, rounded, table, tracks


@query("examine_dataset", """
SELECT count(*) AS rows, CAST(5 AS BIGINT) AS columns,
       count(*) FILTER (WHERE contains(source, 'src1')) AS source_check,
       count(*) FILTER (WHERE contains(lang, 'en')) AS lang_check FROM documents""")
def examine_dataset(spark, d):
    return P.examine(table(spark, d, "documents"), {"source_check": ("source", "src1"), "lang_check": ("lang", "en")})


@query("placeholder_date_share", """
SELECT count(*) FILTER (WHERE strftime(o_orderdate, '%m-%d') = '01-01') AS matching, count(*) AS total,
       round(100.0 * count(*) FILTER (WHERE strftime(o_orderdate, '%m-%d') = '01-01') / count(*), 2) AS percentage
FROM orders""")
def placeholder_date_share(spark, d):
    return P.placeholder_date_share(table(spark, d, "orders"), "o_orderdate")


@query("year_only_date_share", """
WITH t AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y')
                       ELSE strftime(o_orderdate, '%Y-%m-%d') END AS release_date FROM orders)
SELECT count(*) FILTER (WHERE length(release_date) = 4) AS matching, count(*) AS total,
       round(100.0 * count(*) FILTER (WHERE length(release_date) = 4) / count(*), 2) AS percentage FROM t""")
def year_only_date_share(spark, d):
    year_text = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    return P.year_only_share(table(spark, d, "orders").select(year_text.alias("release_date")), "release_date")


@query("value_frequency", """
SELECT l_suppkey, count(*) AS count FROM lineitem GROUP BY l_suppkey ORDER BY count DESC, l_suppkey LIMIT 10""")
def value_frequency(spark, d):
    return P.value_frequency(table(spark, d, "lineitem"), "l_suppkey", 10)


@query("distinct_counts", """
SELECT count(DISTINCT l_suppkey) AS distinct_l_suppkey, count(DISTINCT l_partkey) AS distinct_l_partkey FROM lineitem""")
def distinct_counts(spark, d):
    return P.distinct_counts(table(spark, d, "lineitem"), ["l_suppkey", "l_partkey"])


@query("row_funnel", """
SELECT count(*) AS all_rows, count(*) FILTER (WHERE ok) AS complete_rows,
       count(*) FILTER (WHERE ok AND o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') AS in_range_rows
FROM (SELECT o_orderdate, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END IS NOT NULL AS ok FROM orders)""")
def row_funnel(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderdate", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"))
    return P.row_funnel(rows, "o_orderdate", "1996-01-01", "1999-12-31")


@query("null_counts", """
SELECT 'id' AS column_name, CAST(0 AS BIGINT) AS nulls
UNION ALL SELECT 'price', count(*) FILTER (WHERE o_orderkey % 7 = 0) FROM orders""")
def null_counts(spark, d):
    return P.null_counts(table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price")))


_DESCRIBE = """
  count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min,
  round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
  round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS max"""
_STATS = ["mean", "std", "min", "p25", "p50", "p75", "max"]


@query("describe_columns", f"""
WITH {TRACK_SQL}, long AS (
  SELECT 'q' AS metric, q AS v FROM tracks UNION ALL SELECT 'p', p FROM tracks
  UNION ALL SELECT 'd', d FROM tracks UNION ALL SELECT 't', t FROM tracks)
SELECT metric, {_DESCRIBE} FROM long GROUP BY metric""")
def describe_columns(spark, d):
    return rounded(P.describe(tracks(spark, d), FEATURES), _STATS)


@query("describe_by_hour", f"""
WITH long AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, value AS v FROM events)
SELECT hour, 'value' AS metric, {_DESCRIBE} FROM long GROUP BY hour""")
def describe_by_hour(spark, d):
    rows = table(spark, d, "events").select(F.hour("ts").alias("hour"), "value")
    return rounded(P.describe(rows, ["value"], ["hour"]), _STATS)


@query("preview_first_rows", """
SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 5""")
def preview_first_rows(spark, d):
    return P.preview(table(spark, d, "events"), ["ts", "event_id"], 5).select("event_id", "value")


@query("preview_last_rows", """
SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 5""")
def preview_last_rows(spark, d):
    return P.preview(table(spark, d, "events"), ["ts", "event_id"], 5, last=True).select("event_id", "value")


@query("distinct_values", "SELECT DISTINCT p_type FROM part")
def distinct_values(spark, d):
    return P.distinct_values(table(spark, d, "part"), "p_type")
