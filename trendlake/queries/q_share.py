"""Count, share and group-profile queries."""

from pyspark.sql import functions as F

from trendlake.functions.lists import parse_list_json
from trendlake.operators import shares as S
from trendlake.operators.grid import histogram_centres, histograms
from trendlake.operators.smooth import loess
from trendlake.queries.base import (
    FEATURES, LITERAL_SQL, SPACE_SQL, TRACK_SQL, literals, query, r, rounded, space, table, tracks,
)

_ITEMS = """items AS (SELECT id, unnest(string_split(replace(replace(replace(genres, '[', ''), ']', ''), '''', ''), ', ')) AS item FROM literals)"""


def _lists(spark, d):
    return literals(spark, d).select("id", "p_type", parse_list_json("genres").alias("items"))


@query("item_counts", f"WITH {LITERAL_SQL}, {_ITEMS} SELECT item, count(*) AS count FROM items GROUP BY item")
def item_counts(spark, d):
    return S.item_counts(_lists(spark, d), "items")


@query("top_items", f"""
WITH {LITERAL_SQL}, {_ITEMS} SELECT item, count(*) AS count FROM items GROUP BY item ORDER BY count DESC, item LIMIT 5""")
def top_items(spark, d):
    return S.item_counts(_lists(spark, d), "items", n=5)


@query("unique_tracks_per_first_item", f"""
WITH {LITERAL_SQL} SELECT string_split(replace(replace(replace(genres, '[', ''), ']', ''), '''', ''), ', ')[1] AS item,
  count(DISTINCT p_type) AS unique_count FROM literals GROUP BY 1""")
def unique_tracks_per_first_item(spark, d):
    return S.first_item_uniques(_lists(spark, d), "items", "p_type")


@query("keyword_shares", f"""
WITH {LITERAL_SQL}, t AS (SELECT CASE WHEN id % 10 = 0 THEN '[]' ELSE genres END AS genres FROM literals),
c AS (
  SELECT 'empty' AS bucket, count(*) FILTER (WHERE genres = '[]') AS count FROM t
  UNION ALL SELECT 'ring', count(*) FILTER (WHERE contains(genres, 'ring')) FROM t
  UNION ALL SELECT 'red', count(*) FILTER (WHERE contains(genres, 'red')) FROM t
  UNION ALL SELECT 'in', count(*) FILTER (WHERE contains(genres, 'in')) FROM t
  UNION ALL SELECT 'others', count(*) FILTER (WHERE genres <> '[]' AND NOT contains(genres, 'ring')
                                              AND NOT contains(genres, 'red') AND NOT contains(genres, 'in')) FROM t)
SELECT bucket, count, round(100.0 * count / (SELECT count(*) FROM t), 2) AS percentage FROM c""")
def keyword_shares(spark, d):
    t = literals(spark, d).select(F.when(F.col("id") % 10 == 0, "[]").otherwise(F.col("genres")).alias("genres"))
    return S.keyword_shares(t, "genres", ["ring", "red", "in"])


@query("cluster_sizes", "SELECT label AS prediction, count(*) AS n FROM embeddings GROUP BY label")
def cluster_sizes(spark, d):
    return S.cluster_sizes(space(spark, d))


@query("small_clusters_dropped", """
SELECT vec_id, label AS prediction FROM embeddings WHERE label IN (
  SELECT label FROM embeddings GROUP BY label HAVING count(*) >= (SELECT count(*) / 10.0 FROM embeddings))""")
def small_clusters_dropped(spark, d):
    s = space(spark, d)
    tenth = -(-s.count() // 10)
    return S.drop_small_clusters(s, tenth).select("vec_id", "prediction")


@query("cluster_distribution", f"""
WITH {SPACE_SQL} SELECT CAST(k AS INTEGER) AS prediction, count(vec_id) AS n FROM range(14) s(k) LEFT JOIN space ON prediction = k GROUP BY k""")
def cluster_distribution(spark, d):
    return S.cluster_distribution(space(spark, d), 14)


@query("cluster_share_by_year", f"""
WITH {SPACE_SQL} SELECT year, prediction, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY year), 6) AS share FROM space GROUP BY year, prediction""")
def cluster_share_by_year(spark, d):
    return S.cluster_share(space(spark, d), "year").withColumn("share", r("share"))


@query("cluster_share_by_year_wide", f"""
WITH {SPACE_SQL} SELECT year, {', '.join(f"round(count(*) FILTER (WHERE prediction = {k}) / count(*), 6) AS cluster_{k}" for k in range(10))}
FROM space GROUP BY year""")
def cluster_share_by_year_wide(spark, d):
    return rounded(S.cluster_share_wide(space(spark, d), "year", 10), [f"cluster_{k}" for k in range(10)])


@query("cluster_share_by_date", f"""
WITH t AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_orderkey % 4 AS INTEGER) AS prediction FROM orders)
SELECT day, {', '.join(f"round(count(*) FILTER (WHERE prediction = {k}) / count(*), 6) AS cluster_{k}" for k in range(4))} FROM t GROUP BY day""")
def cluster_share_by_date(spark, d):
    t = table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), (F.col("o_orderkey") % 4).cast("int").alias("prediction"))
    return rounded(S.cluster_share_wide(t, "day", 4), [f"cluster_{k}" for k in range(4)])


@query("cluster_profile", f"""
WITH {TRACK_SQL}, s AS (SELECT avg(q) mq, stddev_samp(q) sq, avg(p) mp, stddev_samp(p) sp, avg(d) md, stddev_samp(d) sd, avg(t) mt, stddev_samp(t) st FROM tracks)
SELECT artist AS prediction, round(avg((q - mq) / sq), 6) AS q, round(avg((p - mp) / sp), 6) AS p,
       round(avg((d - md) / sd), 6) AS d, round(avg((t - mt) / st), 6) AS t FROM tracks, s GROUP BY artist""")
def cluster_profile(spark, d):
    return rounded(S.cluster_profile(tracks(spark, d).withColumnRenamed("artist", "prediction"), FEATURES), FEATURES)


_DOCS = """docs AS (
  SELECT doc_id % 7 + 2000 AS year, source AS artist, CAST(doc_id AS VARCHAR) AS name, n_chars % 100 AS popularity,
         CAST(n_chars AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS blanks FROM documents)"""


def _docs(spark, d):
    blanks = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    return table(spark, d, "documents").select(
        (F.col("doc_id") % 7 + 2000).alias("year"), F.col("source").alias("artist"),
        F.col("doc_id").cast("string").alias("name"), (F.col("n_chars") % 100).alias("popularity"),
        F.col("n_chars").cast("double").alias("chars"), blanks.cast("double").alias("blanks"))


_TREND = f"""{_DOCS}, long AS (
  SELECT year, artist, name, popularity, 'chars' AS metric, chars AS v FROM docs
  UNION ALL SELECT year, artist, name, popularity, 'blanks', blanks FROM docs),
scaled AS (SELECT *, (v - min(v) OVER (PARTITION BY metric)) / (max(v) OVER (PARTITION BY metric) - min(v) OVER (PARTITION BY metric)) AS s FROM long)"""


@query("artist_trend_table", f"""
WITH {_TREND}, ranked AS (SELECT *, row_number() OVER (PARTITION BY year, artist, metric ORDER BY popularity DESC, name) AS rn FROM scaled)
SELECT year, artist, metric, max(CASE WHEN rn = 1 THEN name END) AS name, round(avg(s), 6) AS mean_val,
       round(min(s), 6) AS min_val, round(max(s), 6) AS max_val, round(stddev_samp(s), 6) AS sd_val
FROM ranked GROUP BY year, artist, metric""")
def artist_trend_table(spark, d):
    out = S.group_trend_table(_docs(spark, d), ["chars", "blanks"])
    return rounded(out, ["mean_val", "min_val", "max_val", "sd_val"])


_LOESS = """pts AS (SELECT artist, year, avg(y) AS y FROM (SELECT source AS artist, CAST(doc_id % 17 AS INTEGER) + 2000 AS year, n_chars / 1000.0 AS y FROM documents) GROUP BY ALL),
near AS (
  SELECT a.artist, a.year, a.y AS y0, CAST(b.year - a.year AS DOUBLE) AS u, b.y AS y,
         row_number() OVER (PARTITION BY a.artist, a.year ORDER BY abs(b.year - a.year), b.year) AS rn,
         greatest(floor(0.75 * count(*) OVER (PARTITION BY a.artist, a.year) + 0.00001), 1) AS k
  FROM pts a JOIN pts b ON a.artist = b.artist),
reach AS (SELECT *, max(CASE WHEN rn = k THEN abs(u) END) OVER (PARTITION BY artist, year) AS h FROM near),
weighted AS (SELECT *, CASE WHEN abs(u) < h THEN pow(1 - pow(abs(u) / h, 3), 3) WHEN u = 0 THEN 1 ELSE 0 END AS w FROM reach),
m AS (SELECT artist, year, max(y0) AS y, sum(w) s0, sum(w*u) s1, sum(w*u*u) s2, sum(w*u*u*u) s3, sum(w*u*u*u*u) s4,
             sum(w*y) t0, sum(w*u*y) t1, sum(w*u*u*y) t2 FROM weighted GROUP BY artist, year),
f AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS d3, s0*s2 - s1*s1 AS d2 FROM m)"""


@query("loess_of_yearly_means", f"""
WITH {_LOESS}
SELECT artist, year, round(y, 4) AS y, round(CASE
  WHEN d3 > s0*s2*s4*1e-9 THEN (t0*(s2*s4-s3*s3) - s1*(t1*s4-t2*s3) + s2*(t1*s3-t2*s2)) / d3
  WHEN d2 > s0*s2*1e-9 THEN (t0*s2 - s1*t1) / d2 ELSE t0 / s0 END, 4) AS smooth FROM f""")
def loess_of_yearly_means(spark, d):
    rows = table(spark, d, "documents").select(
        F.col("source").alias("artist"), ((F.col("doc_id") % 17).cast("int") + 2000).alias("year"), (F.col("n_chars") / 1000.0).alias("v"))
    yearly = rows.groupBy("artist", "year").agg(F.avg("v").alias("mean_val"))
    return rounded(loess(yearly, ["artist"]), ["y", "smooth"], 4)


@query("standardized_histograms", f"""
WITH {TRACK_SQL}, z AS (
  SELECT 'q' AS metric, (q - avg(q) OVER ()) / stddev_samp(q) OVER () AS v FROM tracks
  UNION ALL SELECT 'p', (p - avg(p) OVER ()) / stddev_samp(p) OVER () FROM tracks),
l AS (SELECT metric, min(v) AS lo, max(v) AS hi FROM z GROUP BY metric),
c AS (SELECT metric, least(floor((v - lo) / (hi - lo) * 30), 29) AS bin, count(*) AS n FROM z JOIN l USING (metric) GROUP BY ALL)
SELECT l.metric, CAST(b AS INTEGER) AS bin, round(lo + (hi - lo) / 30 * b, 6) AS bin_low, round(lo + (hi - lo) / 30 * (b + 1), 6) AS bin_high,
       coalesce(n, 0) AS count FROM l CROSS JOIN range(30) r(b) LEFT JOIN c ON c.metric = l.metric AND c.bin = b""")
def standardized_histograms(spark, d):
    return rounded(histograms(tracks(spark, d), ["q", "p"], 30), ["bin_low", "bin_high"])


@query("histogram_centres", f"""
WITH {TRACK_SQL}, z AS (
  SELECT 'q' AS metric, (q - avg(q) OVER ()) / stddev_samp(q) OVER () AS v FROM tracks
  UNION ALL SELECT 'p', (p - avg(p) OVER ()) / stddev_samp(p) OVER () FROM tracks)
SELECT metric, round(avg(v), 5) + 0.0 AS mean, round(quantile_cont(v, 0.5), 5) + 0.0 AS median FROM z GROUP BY metric""")
def histogram_centres_of_features(spark, d):
    return rounded(histogram_centres(tracks(spark, d), ["q", "p"]), ["mean", "median"], 5)


@query("box_plot_by_group", """
WITH q AS (SELECT source, count(*) AS n, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median,
                  quantile_cont(n_chars, 0.75) AS q3 FROM documents GROUP BY source),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT source, 'n_chars' AS metric, n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
       CAST(min(n_chars) FILTER (WHERE n_chars BETWEEN lo AND hi) AS DOUBLE) AS whisker_low,
       CAST(max(n_chars) FILTER (WHERE n_chars BETWEEN lo AND hi) AS DOUBLE) AS whisker_high,
       count(*) FILTER (WHERE NOT n_chars BETWEEN lo AND hi) AS outliers
FROM documents JOIN f USING (source) GROUP BY ALL""")
def box_plot_by_group(spark, d):
    out = S.box_plot(table(spark, d, "documents", "source", "n_chars"), "source", ["n_chars"])
    return rounded(out, ["q1", "median", "q3"], 4)
