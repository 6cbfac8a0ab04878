"""Grid, histogram and density queries."""


from trendlake.operators import density as K
from trendlake.operators import grid as G
from trendlake.queries.base import DIMS, SPACE_SQL, TRACK_SQL, query, rounded, space, tracks

TWO = ["q", "p"]
_LIM = "lim AS (SELECT min(q) lq, max(q) hq, min(p) lp, max(p) hp FROM tracks)"


def _bins(kind, cells):
    def axis(c):
        f = f"floor(({c} - l{c}) / (h{c} - l{c}) * {cells})"
        if kind == "digitize":
            return f"CAST(CASE WHEN {c} >= h{c} THEN {cells} ELSE {f} END AS INTEGER)"
        return f"CAST(greatest(least({f}, {cells - 1}), 0) AS INTEGER)"
    return f"{_LIM}, b AS (SELECT year, {axis('q')} AS x_bin, {axis('p')} AS y_bin FROM tracks, lim)"


_COUNTS = "SELECT year, x_bin, y_bin, count(*) AS count FROM b GROUP BY ALL"


@query("yearly_grid_clamped", f"WITH {TRACK_SQL}, {_bins('clamp', 70)} {_COUNTS}")
def yearly_grid_clamped(spark, d):
    return G.yearly_grid(tracks(spark, d), TWO, 70)


@query("yearly_grid_digitized", f"WITH {TRACK_SQL}, {_bins('digitize', 29)} {_COUNTS}")
def yearly_grid_digitized(spark, d):
    return G.yearly_grid(tracks(spark, d), TWO, 29, "digitize")


@query("yearly_histogram_2d", f"WITH {TRACK_SQL}, {_bins('close', 49)} {_COUNTS}")
def yearly_histogram_2d(spark, d):
    return G.yearly_histogram_2d(tracks(spark, d), TWO, 50)


@query("grid_scaled_per_year", f"""
WITH {TRACK_SQL}, {_bins('clamp', 20)}, g AS ({_COUNTS})
SELECT *, round(CASE WHEN max(count) OVER w > min(count) OVER w
  THEN (count - min(count) OVER w) / (max(count) OVER w - min(count) OVER w) ELSE 0.0 END, 6) AS normalized_count
FROM g WINDOW w AS (PARTITION BY year)""")
def grid_scaled_per_year(spark, d):
    return rounded(G.scale_grid(G.yearly_grid(tracks(spark, d), TWO, 20)), ["normalized_count"])


@query("dense_yearly_matrix", f"""
WITH {TRACK_SQL}, {_bins('clamp', 20)}, g AS ({_COUNTS})
SELECT y.year, CAST(a AS INTEGER) AS x_bin, CAST(c AS INTEGER) AS y_bin, coalesce(count, 0) AS count
FROM (SELECT DISTINCT year FROM g) y CROSS JOIN range(20) i(a) CROSS JOIN range(20) j(c)
LEFT JOIN g ON g.year = y.year AND x_bin = a AND y_bin = c""")
def dense_yearly_matrix(spark, d):
    return G.dense_grid(G.yearly_grid(tracks(spark, d), TWO, 20), 20)


@query("era_map", f"""
WITH {TRACK_SQL}, {_bins('digitize', 19)}
SELECT x_bin, y_bin, round(avg(year), 6) AS mean_year, count(*) AS count FROM b WHERE x_bin < 19 AND y_bin < 19 GROUP BY ALL""")
def era_map(spark, d):
    return rounded(G.era_map(tracks(spark, d), TWO, 20), ["mean_year"])


@query("era_matrix", f"""
WITH {SPACE_SQL.replace('DOUBLE) AS x,', 'DOUBLE) AS q,').replace('DOUBLE) AS y', 'DOUBLE) AS p').replace('space AS', 'tracks AS')}, {_bins('digitize', 19)},
e AS (SELECT x_bin, y_bin, avg(year) AS mean_year FROM b WHERE x_bin < 19 AND y_bin < 19 GROUP BY ALL)
SELECT CAST(i AS INTEGER) AS x_bin, CAST(j AS INTEGER) AS y_bin, round(mean_year, 6) AS mean_year
FROM range(19) a(i) CROSS JOIN range(19) c(j) LEFT JOIN e ON x_bin = i AND y_bin = j""")
def era_matrix(spark, d):
    return rounded(G.era_matrix(G.era_map(space(spark, d), "score", 20, DIMS), 20), ["mean_year"])


def _density(width):
    return f"""
WITH {SPACE_SQL}, long AS (
  SELECT CAST(floor(year / {width}.0) * {width} AS INTEGER) AS period, CAST(0 AS INTEGER) AS dim, x AS v FROM space
  UNION ALL SELECT CAST(floor(year / {width}.0) * {width} AS INTEGER), 1, y FROM space),
lim AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM long GROUP BY dim),
h AS (SELECT period, dim, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h FROM long GROUP BY period, dim HAVING count(*) > 1 AND stddev_samp(v) > 0),
k AS (SELECT period, dim, CAST(i AS INTEGER) AS point, lo + (hi - lo) * i / 199.0 AS x,
             avg(exp(-0.5 * pow((lo + (hi - lo) * i / 199.0 - v) / h, 2))) / (max(h) * sqrt(2 * pi())) AS density
      FROM long JOIN h USING (period, dim) JOIN lim USING (dim) CROSS JOIN range(200) g(i) GROUP BY period, dim, i, lo, hi)"""


@query("density_per_year", _density(1) + " SELECT period, dim, point, round(x, 6) + 0.0 AS x, round(density, 6) AS density FROM k")
def density_per_year(spark, d):
    return rounded(K.density_curves(space(spark, d), "score", 2), ["x", "density"])


@query("density_per_five_years", _density(5) + " SELECT period, dim, point, round(x, 6) + 0.0 AS x, round(density, 6) AS density FROM k")
def density_per_five_years(spark, d):
    return rounded(K.density_curves(space(spark, d), "score", 2, width=5), ["x", "density"])


@query("density_peaks", _density(1) + " SELECT dim, round(max(density), 6) AS max_density FROM k GROUP BY dim")
def density_peaks(spark, d):
    return rounded(K.density_peaks(K.density_curves(space(spark, d), "score", 2)), ["max_density"])
