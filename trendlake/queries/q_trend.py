"""Yearly centre, dispersion, movement and novelty queries."""

from pyspark.sql import functions as F

from trendlake.operators import trends as T
from trendlake.queries.base import DIMS, FEATURES, SPACE_SQL, TRACK_SQL, query, r, rounded, space, tracks

_DIST = "sqrt(pow(q - cq, 2) + pow(p - cp, 2) + pow(d - cd, 2) + pow(t - ct, 2))"
_AVG = "avg(q) AS cq, avg(p) AS cp, avg(d) AS cd, avg(t) AS ct"
_SUMMARY = """round(avg(distance), 6) AS avg_distance, round({std}(distance), 6) AS std_distance,
       round({std}(distance) / sqrt(count(*)), 6) AS se_distance, count(*) AS song_count"""
SUMMARY = _SUMMARY.format(std="stddev_samp")
SUMMARY_COLS = ["avg_distance", "std_distance", "se_distance"]


@query("yearly_dispersion", f"""
WITH {TRACK_SQL}, c AS (SELECT year, {_AVG} FROM tracks GROUP BY year),
dist AS (SELECT year, {_DIST} AS distance FROM tracks JOIN c USING (year))
SELECT year, {SUMMARY} FROM dist GROUP BY year""")
def yearly_dispersion(spark, d):
    return rounded(T.yearly_dispersion(tracks(spark, d), FEATURES), SUMMARY_COLS)


@query("yearly_dispersion_all_dims", f"""
WITH {SPACE_SQL}, long AS (SELECT vec_id, year, unnest(range(1, 65)) AS i, CAST(unnest(score) AS DOUBLE) AS v FROM space),
c AS (SELECT year, i, avg(v) AS m FROM long GROUP BY year, i),
dist AS (SELECT year, vec_id, sqrt(sum(pow(v - m, 2))) AS distance FROM long JOIN c USING (year, i) GROUP BY year, vec_id)
SELECT year, {SUMMARY} FROM dist GROUP BY year""")
def yearly_dispersion_all_dims(spark, d):
    return rounded(T.yearly_dispersion(space(spark, d), "score", DIMS), SUMMARY_COLS)


@query("yearly_similarity", f"""
WITH {TRACK_SQL}, c AS (SELECT year, {_AVG} FROM tracks GROUP BY year),
dist AS (SELECT year, {_DIST} AS distance FROM tracks JOIN c USING (year))
SELECT year, round(avg(distance), 6) AS avg_distance, round(stddev_pop(distance), 6) AS std_distance FROM dist GROUP BY year""")
def yearly_similarity(spark, d):
    out = T.yearly_dispersion(tracks(spark, d), FEATURES, ddof=0)
    return rounded(out, SUMMARY_COLS).select("year", "avg_distance", "std_distance")


@query("global_centre", f"""
WITH {TRACK_SQL} SELECT CAST(0 AS INTEGER) AS dim, round(avg(q), 6) AS centre FROM tracks UNION ALL SELECT 1, round(avg(p), 6) FROM tracks
UNION ALL SELECT 2, round(avg(d), 6) FROM tracks UNION ALL SELECT 3, round(avg(t), 6) FROM tracks""")
def global_centre(spark, d):
    return rounded(T.global_centre(tracks(spark, d), FEATURES), ["centre"])


@query("yearly_centre", f"""
WITH {SPACE_SQL} SELECT year, round(avg(x), 6) + 0.0 AS cx, round(avg(y), 6) + 0.0 AS cy, count(*) AS n FROM space GROUP BY year""")
def yearly_centre(spark, d):
    return rounded(T.yearly_centre(space(spark, d), "score", DIMS), ["cx", "cy"])


@query("yearly_movement", f"""
WITH {TRACK_SQL}, c AS (SELECT year, avg(q) AS cx, avg(p) AS cy, count(*) AS n FROM tracks GROUP BY year),
m AS (SELECT *, cx - lag(cx) OVER (ORDER BY year) AS dx, cy - lag(cy) OVER (ORDER BY year) AS dy FROM c)
SELECT year, n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy,
       round(sqrt(dx * dx + dy * dy), 6) AS step FROM m""")
def yearly_movement(spark, d):
    return rounded(T.yearly_movement(tracks(spark, d), FEATURES), ["cx", "cy", "dx", "dy", "step"])


_ARTIST = f"a AS (SELECT year, artist, count(*) AS n, {_AVG} FROM tracks GROUP BY year, artist)"


@query("within_artist_dispersion", f"""
WITH {TRACK_SQL}, {_ARTIST}, dist AS (SELECT year, {_DIST} AS distance FROM tracks JOIN a USING (year, artist))
SELECT year, {SUMMARY} FROM dist GROUP BY year""")
def within_artist_dispersion(spark, d):
    return rounded(T.within_artist_dispersion(tracks(spark, d), FEATURES), SUMMARY_COLS)


@query("within_artist_dispersion_repeat_artists", f"""
WITH {TRACK_SQL.replace('l_suppkey', 'l_partkey')}, {_ARTIST},
dist AS (SELECT year, {_DIST} AS distance FROM tracks JOIN a USING (year, artist) WHERE n > 1)
SELECT year, {_SUMMARY.format(std='stddev_pop')} FROM dist GROUP BY year""")
def within_artist_dispersion_repeat_artists(spark, d):
    t = tracks(spark, d).withColumn("artist", F.col("name"))
    return rounded(T.within_artist_dispersion(t, FEATURES, min_songs=2, ddof=0), SUMMARY_COLS)


@query("between_artist_dispersion", f"""
WITH {TRACK_SQL}, {_ARTIST.replace('a AS', 'aa AS', 1)},
tt AS (SELECT year, cq AS q, cp AS p, cd AS d, ct AS t FROM aa), c AS (SELECT year, {_AVG} FROM tt GROUP BY year),
dist AS (SELECT year, {_DIST} AS distance FROM tt JOIN c USING (year))
SELECT year, {SUMMARY.replace('song_count', 'artist_count')} FROM dist GROUP BY year""")
def between_artist_dispersion(spark, d):
    return rounded(T.between_artist_dispersion(tracks(spark, d), FEATURES), SUMMARY_COLS)


@query("between_artist_pairwise", f"""
WITH {TRACK_SQL}, {_ARTIST}
SELECT a.year, round(avg(sqrt(pow(a.cq - b.cq, 2) + pow(a.cp - b.cp, 2) + pow(a.cd - b.cd, 2) + pow(a.ct - b.ct, 2))), 6) AS avg_distance,
       count(*) AS pair_count FROM a JOIN a b ON a.year = b.year AND a.artist < b.artist GROUP BY a.year""")
def between_artist_pairwise(spark, d):
    return rounded(T.between_artist_pairwise(tracks(spark, d), FEATURES), ["avg_distance"])


@query("artist_history_distance", f"""
WITH {TRACK_SQL}, s AS (SELECT year, artist, count(*) AS n, sum(q) sq, sum(p) sp, sum(d) sd, sum(t) st FROM tracks GROUP BY year, artist),
h AS (SELECT year, artist, sum(sq) OVER w / sum(n) OVER w AS cq, sum(sp) OVER w / sum(n) OVER w AS cp,
             sum(sd) OVER w / sum(n) OVER w AS cd, sum(st) OVER w / sum(n) OVER w AS ct
      FROM s WINDOW w AS (PARTITION BY artist ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dist AS (SELECT year, {_DIST} AS distance FROM tracks JOIN h USING (year, artist) WHERE cq IS NOT NULL)
SELECT year, round(avg(distance), 6) AS avg_distance, count(*) AS song_count FROM dist GROUP BY year""")
def artist_history_distance(spark, d):
    return rounded(T.artist_history_distance(tracks(spark, d), FEATURES), ["avg_distance"])


_HIST = """s AS (SELECT year, count(*) AS n, sum(q) sq, sum(p) sp FROM tracks GROUP BY year),
h AS (SELECT year, n, sq / n AS cq, sp / n AS cp, sum(sq) OVER w / sum(n) OVER w AS hq, sum(sp) OVER w / sum(n) OVER w AS hp
      FROM s WINDOW w AS (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dist AS (SELECT year, cq, cp, hq, hp, sqrt(pow(q - cq, 2) + pow(p - cp, 2)) AS current_distance,
                sqrt(pow(q - hq, 2) + pow(p - hp, 2)) AS historical_distance FROM tracks JOIN h USING (year))"""
TWO = ["q", "p"]


@query("historical_centres", f"""
WITH {TRACK_SQL}, {_HIST} SELECT year, n, round(cq, 6) AS c0, round(cp, 6) AS c1, round(hq, 6) AS h0, round(hp, 6) AS h1 FROM h""")
def historical_centres(spark, d):
    return rounded(T.historical_centres(tracks(spark, d), TWO), ["c0", "c1", "h0", "h1"])


@query("yearly_innovation", f"""
WITH {TRACK_SQL}, {_HIST} SELECT year, round(avg(current_distance), 6) AS within_year,
       round(sqrt(pow(max(cq) - max(hq), 2) + pow(max(cp) - max(hp), 2)), 6) AS between_year FROM dist GROUP BY year""")
def yearly_innovation(spark, d):
    return rounded(T.yearly_innovation(tracks(spark, d), TWO), ["within_year", "between_year"])


@query("row_distances", f"""
WITH {TRACK_SQL}, {_HIST} SELECT year, round(current_distance, 6) AS current_distance,
       round(historical_distance, 6) AS historical_distance FROM dist""")
def row_distances(spark, d):
    return rounded(T.row_distances(tracks(spark, d), TWO), ["current_distance", "historical_distance"])


EDGES = [0, 1, 2, 3, 100]


def _levels(column):
    return ", ".join(
        f"count(*) FILTER (WHERE {column} >= {lo} AND {column} < {hi}) AS \"{lo:.1f}-{hi:.1f}\"" for lo, hi in zip(EDGES, EDGES[1:]))


@query("innovation_levels_internal", f"WITH {TRACK_SQL}, {_HIST} SELECT year, {_levels('current_distance')} FROM dist GROUP BY year")
def innovation_levels_internal(spark, d):
    return T.innovation_levels(tracks(spark, d), TWO, EDGES)


@query("innovation_levels_historical", f"WITH {TRACK_SQL}, {_HIST} SELECT year, {_levels('historical_distance')} FROM dist GROUP BY year")
def innovation_levels_historical(spark, d):
    return T.innovation_levels(tracks(spark, d), TWO, EDGES, distance="historical")


@query("innovation_levels_all_dims", f"""
WITH {TRACK_SQL}, c AS (SELECT year, {_AVG} FROM tracks GROUP BY year),
dist AS (SELECT year, {_DIST} AS distance FROM tracks JOIN c USING (year)) SELECT year, {_levels('distance')} FROM dist GROUP BY year""")
def innovation_levels_all_dims(spark, d):
    return T.innovation_levels(tracks(spark, d), FEATURES, EDGES, dims=None)


@query("innovation_levels_long", f"""
WITH {TRACK_SQL}, {_HIST}, w AS (SELECT year, {_levels('current_distance')} FROM dist GROUP BY year)
SELECT year, bin, y FROM w UNPIVOT (y FOR bin IN ({', '.join(f'"{lo:.1f}-{hi:.1f}"' for lo, hi in zip(EDGES, EDGES[1:]))}))""")
def innovation_levels_long(spark, d):
    return T.levels_long(T.innovation_levels(tracks(spark, d), TWO, EDGES))


@query("yearly_distance_values", f"""
WITH {TRACK_SQL}, {_HIST} SELECT year, round(current_distance, 6) AS value FROM dist""")
def yearly_distance_values(spark, d):
    return rounded(T.yearly_values(T.row_distances(tracks(spark, d), TWO), "year", "current_distance"), ["value"])


@query("feature_trends", f"""
WITH {TRACK_SQL}, y AS (
  SELECT year, 'q' AS feature, avg(q) AS mean, stddev_samp(q) / sqrt(count(q)) AS se FROM tracks GROUP BY year
  UNION ALL SELECT year, 'p', avg(p), stddev_samp(p) / sqrt(count(p)) FROM tracks GROUP BY year),
s AS (SELECT year, feature, mean, (mean - min(mean) OVER w) / (max(mean) OVER w - min(mean) OVER w) AS scaled_mean,
             se / (max(mean) OVER w - min(mean) OVER w) AS scaled_se FROM y WINDOW w AS (PARTITION BY feature))
SELECT year, feature, round(mean, 6) AS mean, round(scaled_mean, 6) AS scaled_mean, round(scaled_se, 6) AS scaled_se,
       round(CASE WHEN count(*) OVER f = 3 THEN avg(scaled_mean) OVER f END, 6) AS trend,
       round(CASE WHEN count(*) OVER f = 3 THEN avg(scaled_se) OVER f END, 6) AS trend_se
FROM s WINDOW f AS (PARTITION BY feature ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def feature_trends(spark, d):
    return rounded(T.feature_trends(tracks(spark, d), TWO, 3), ["mean", "scaled_mean", "scaled_se", "trend", "trend_se"])


@query("linear_trend_of_dispersion", f"""
WITH {TRACK_SQL}, c AS (SELECT year, {_AVG} FROM tracks GROUP BY year),
dist AS (SELECT year, {_DIST} AS distance FROM tracks JOIN c USING (year)), y AS (SELECT year, avg(distance) AS v FROM dist GROUP BY year)
SELECT round(regr_slope(v, year), 6) AS slope, round(regr_intercept(v, year), 4) AS intercept, round(regr_r2(v, year), 6) AS r2 FROM y""")
def linear_trend_of_dispersion(spark, d):
    t = T.linear_trend(T.yearly_dispersion(tracks(spark, d), FEATURES), "year", "avg_distance")
    return t.select(r("slope").alias("slope"), r("intercept", 4).alias("intercept"), r("r2").alias("r2"))
