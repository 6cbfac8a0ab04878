"""The whole analyses as queries."""

from pyspark.sql import functions as F

from trendlake.functions.dates import year_of
from trendlake.operators import forecast as R
from trendlake.operators.shares import cluster_share
from trendlake.plans import flows
from trendlake.queries.base import FEATURES, LITERAL_SQL, TRACK_SQL, literals, query, r, rounded, scratch, table, tracks
from trendlake.sources.files import TRACK_RAW_COLUMNS, write_csv


def _track_text(spark, d):
    """lineitem and part as the raw track table, every column text."""
    li = table(spark, d, "lineitem").join(
        table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    text = {
        "id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"), "name": F.col("p_name"),
        "popularity": F.col("l_linenumber"), "explicit": F.col("l_returnflag") == "R",
        "artists": F.concat(F.lit("['"), F.replace("p_name", F.lit(" "), F.lit("', '")), F.lit("']")),
        "release_date": F.date_format("l_shipdate", "yyyy-MM-dd"), "energy": F.col("l_discount"),
        "loudness": -F.col("l_tax"), "tempo": F.col("l_quantity"), "duration_ms": F.floor("l_extendedprice"),
    }
    return li.select(*[text.get(c, F.lit("0")).cast("string").alias(c) for c in TRACK_RAW_COLUMNS])


@query("typed_tracks_from_csv", """
WITH t AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, unnest(string_split(p_name, ' ')) AS artist, l_quantity
           FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT year, artist, count(*) AS n, round(sum(l_quantity), 2) AS tempo FROM t GROUP BY ALL""")
def typed_tracks_from_csv(spark, d):
    path = scratch(spark, "tracks")
    write_csv(_track_text(spark, d), path)
    t = flows.raw_tracks(spark, path)
    return t.groupBy(year_of("release_date").alias("year"), "artist").agg(
        F.count("*").alias("n"), r(F.sum("tempo"), 2).alias("tempo"))


@query("tracks_to_cluster_shares")
def tracks_to_cluster_shares(spark, d):
    out = flows.tracks_to_clusters(
        tracks(spark, d), FEATURES, "release_date", "1995-01-01", "2001-12-31", 0.9, ks=[2, 3], min_cluster=100,
        partitions=spark.sparkContext.defaultParallelism)
    return rounded(cluster_share(out.rows, "year"), ["share"])


_D = "sqrt(pow(q - cq, 2) + pow(p - cp, 2) + pow(d - cd, 2) + pow(t - ct, 2))"
_MEAN = "avg(q) AS cq, avg(p) AS cp, avg(d) AS cd, avg(t) AS ct"


@query("yearly_measures_side_by_side", f"""
WITH {TRACK_SQL}, c AS (SELECT year, {_MEAN} FROM tracks GROUP BY year),
disp AS (SELECT year, avg({_D}) AS avg_distance, stddev_samp({_D}) AS std_distance, stddev_samp({_D}) / sqrt(count(*)) AS se_distance,
                count(*) AS song_count FROM tracks JOIN c USING (year) GROUP BY year),
a AS (SELECT year, artist, {_MEAN} FROM tracks GROUP BY year, artist),
within AS (SELECT year, avg({_D}) AS within_artist FROM tracks JOIN a USING (year, artist) GROUP BY year),
ar AS (SELECT year, cq AS q, cp AS p, cd AS d, ct AS t FROM a), ac AS (SELECT year, {_MEAN} FROM ar GROUP BY year),
between_a AS (SELECT year, avg({_D}) AS between_artist FROM ar JOIN ac USING (year) GROUP BY year),
s AS (SELECT year, count(*) AS n, sum(q) AS q, sum(p) AS p, sum(d) AS d, sum(t) AS t FROM tracks GROUP BY year),
h AS (SELECT year, q / n AS q, p / n AS p, d / n AS d, t / n AS t, sum(q) OVER w / sum(n) OVER w AS cq, sum(p) OVER w / sum(n) OVER w AS cp,
             sum(d) OVER w / sum(n) OVER w AS cd, sum(t) OVER w / sum(n) OVER w AS ct FROM s
      WINDOW w AS (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
novel AS (SELECT year, {_D} AS between_year FROM h),
mv AS (SELECT year, cq AS cx, cp AS cy, sqrt(pow(cq - lag(cq) OVER (ORDER BY year), 2) + pow(cp - lag(cp) OVER (ORDER BY year), 2)) AS step FROM c)
SELECT year, song_count, round(avg_distance, 6) AS avg_distance, round(std_distance, 6) AS std_distance, round(se_distance, 6) AS se_distance,
       round(within_artist, 6) AS within_artist, round(between_artist, 6) AS between_artist, round(avg_distance, 6) AS within_year,
       round(between_year, 6) AS between_year, round(cx, 6) AS cx, round(cy, 6) AS cy, round(step, 6) AS step
FROM disp JOIN within USING (year) JOIN between_a USING (year) JOIN novel USING (year) JOIN mv USING (year)""")
def yearly_measures_side_by_side(spark, d):
    t = tracks(spark, d).withColumn("features", F.array(*FEATURES))
    out = flows.yearly_measures(t, len(FEATURES))
    return rounded(out, [c for c in out.columns if c not in ("year", "song_count")])


@query("list_text_to_rule_degrees", f"""
WITH {LITERAL_SQL}, i AS (SELECT id, unnest(list_distinct(string_split(replace(replace(replace(genres, '[', ''), ']', ''), '''', ''), ', '))) AS item FROM literals),
f AS (SELECT item, count(*) AS freq FROM i GROUP BY item),
p AS (SELECT a.item AS source, b.item AS target, count(*) AS n FROM i a JOIN i b ON a.id = b.id AND a.item <> b.item GROUP BY ALL),
e AS (SELECT source, target FROM p JOIN f ON item = source WHERE n >= ceil(0.005 * (SELECT count(*) FROM part)) AND n / freq >= 0.13)
SELECT node, count(*) AS degree FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) GROUP BY node""")
def list_text_to_rule_degrees(spark, d):
    return flows.lists_to_rules(literals(spark, d), "genres", 0.005, 0.13).degrees


@query("counts_to_verified_forecast")
def counts_to_verified_forecast(spark, d):
    hour = F.col("o_orderdate").alias("ts")
    counts = table(spark, d, "orders").groupBy(hour).agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)).alias("wb"),
        F.sum(F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).otherwise(0.0)).alias("eb"))
    design = R.Design(cycles=(("yearly", 365.25, 3), ("weekly", 7.0, 2)), event_years=(1998,))
    out = flows.counts_to_verified_forecast(counts, "wb", "eb", "1995-01-01", "2001-12-31", 2000, design)
    return rounded(out.accuracy, ["r", "r2"]).select("split", "r", "r2", r("mae", 2).alias("mae"), "n")
