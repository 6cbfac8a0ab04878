"""Scaling, reduction and clustering queries.

K-means and its sweeps have no SQL counterpart; the
tests compare them with brute force on small tables instead.
"""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trendlake.functions.vectors import euclidean_arrays
from trendlake.operators import cluster as C
from trendlake.operators import dbscan as D
from trendlake.operators import features as M
from trendlake.operators import hierarchy as H
from trendlake.operators.shares import cluster_sizes
from trendlake.queries.base import DIMS, FEATURES, SPACE_SQL, TRACK_SQL, query, r, rounded, space, table, tracks


def _scaled(spark, d, center=False):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("a"), F.col("o_custkey").alias("b"))
    out, _ = M.scale(o, ["a", "b"], center=center)
    v = vector_to_array("scaled")
    return out.select("id", r(v[0]).alias("a"), r(v[1]).alias("b"))


@query("scaled_features", """
SELECT o_orderkey AS id, round(o_totalprice / stddev_samp(o_totalprice) OVER (), 6) AS a, round(o_custkey / stddev_samp(o_custkey) OVER (), 6) AS b FROM orders""")
def scaled_features(spark, d):
    return _scaled(spark, d)


@query("scaled_features_centred", """
SELECT o_orderkey AS id, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 6) + 0.0 AS a,
       round((o_custkey - avg(o_custkey) OVER ()) / stddev_samp(o_custkey) OVER (), 6) + 0.0 AS b FROM orders""")
def scaled_features_centred(spark, d):
    return _scaled(spark, d, center=True)


# Two features have a closed-form spectrum, so PCA and SVD can be stated in SQL.
_EIGEN = """eig AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS l2 FROM m),
v0 AS (SELECT *, b / sqrt(b * b + pow(l1 - a, 2)) AS e1, (l1 - a) / sqrt(b * b + pow(l1 - a, 2)) AS e2 FROM eig),
vec AS (SELECT *, CASE WHEN abs(e1) >= abs(e2) THEN sign(e1) ELSE sign(e2) END AS s1,
               CASE WHEN abs(e2) >= abs(e1) THEN sign(-e2) ELSE sign(e1) END AS s2 FROM v0),
load AS (SELECT l1, l2, s1 * e1 AS q1, s1 * e2 AS p1, s2 * -e2 AS q2, s2 * e1 AS p2 FROM vec)"""
_COV = f"WITH {TRACK_SQL}, m AS (SELECT var_samp(q) AS a, covar_samp(q, p) AS b, var_samp(p) AS c FROM tracks), {_EIGEN}"
_GRAM = f"WITH {TRACK_SQL}, m AS (SELECT sum(q * q) AS a, sum(q * p) AS b, sum(p * p) AS c FROM tracks), {_EIGEN}"
_VARIANCE = """SELECT CAST(1 AS INTEGER) AS component, round(l1 / (l1 + l2), 6) AS variance, round(l1 / (l1 + l2), 6) AS cumulative FROM load
UNION ALL SELECT 2, round(l2 / (l1 + l2), 6), 1.0 FROM load"""


def _pair(spark, d):
    return M.assemble(tracks(spark, d).select("year", "artist", "q", "p"), ["q", "p"], "v")


@query("pca_explained_variance", f"{_COV} {_VARIANCE}")
def pca_explained_variance(spark, d):
    t = M.fit_pca(_pair(spark, d), "v", 2).table(spark)
    return rounded(t, ["variance", "cumulative"]).drop("kept")


@query("pca_loadings", f"""{_COV}
SELECT 'q' AS feature, CAST(1 AS INTEGER) AS component, round(q1, 6) AS loading FROM load UNION ALL SELECT 'p', 1, round(p1, 6) FROM load
UNION ALL SELECT 'q', 2, round(q2, 6) FROM load UNION ALL SELECT 'p', 2, round(p2, 6) FROM load""")
def pca_loadings(spark, d):
    return rounded(M.fit_pca(_pair(spark, d), "v", 2).loadings_table(spark, ["q", "p"]), ["loading"])


@query("pca_yearly_scores", f"""{_COV}
SELECT year, round(avg(q * q1 + p * p1), 6) AS pc1, round(avg(q * q2 + p * p2), 6) + 0.0 AS pc2 FROM tracks, load GROUP BY year""")
def pca_yearly_scores(spark, d):
    rows = _pair(spark, d)
    out = M.reduce_rows(rows, M.fit_pca(rows, "v", 2, k=2), "v")
    return out.groupBy("year").agg(r(F.avg(out.score[0])).alias("pc1"), r(F.avg(out.score[1])).alias("pc2"))


@query("pca_scores_centred", f"""{_COV}, c AS (SELECT avg(q) AS mq, avg(p) AS mp FROM tracks)
SELECT year, round(avg((q - mq) * q1 + (p - mp) * p1), 5) + 0.0 AS pc1 FROM tracks, load, c GROUP BY year""")
def pca_scores_centred(spark, d):
    rows = _pair(spark, d)
    out = M.reduce_rows(rows, M.fit_pca(rows, "v", 2, k=2), "v", center=True)
    return out.groupBy("year").agg(r(F.avg(out.score[0]), 5).alias("pc1"))


@query("svd_explained_share", f"{_GRAM} {_VARIANCE}")
def svd_explained_share(spark, d):
    return rounded(M.fit_svd(_pair(spark, d), "v", 2).table(spark), ["variance", "cumulative"]).drop("kept")


@query("svd_yearly_scores", f"""{_GRAM}
SELECT year, round(sum(q * q1 + p * p1) / sqrt(max(l1)), 5) AS u1, round(sum(q * q2 + p * p2) / sqrt(max(l2)), 5) + 0.0 AS u2 FROM tracks, load GROUP BY year""")
def svd_yearly_scores(spark, d):
    rows = _pair(spark, d)
    out = M.reduce_rows(rows, M.fit_svd(rows, "v", 2, k=2), "v")
    return out.groupBy("year").agg(r(F.sum(out.score[0]), 5).alias("u1"), r(F.sum(out.score[1]), 5).alias("u2"))


@query("pca_component_choice")
def pca_component_choice(spark, d):
    rows, _ = M.scale(tracks(spark, d), FEATURES)
    return rounded(M.fit_pca(rows, "scaled", len(FEATURES), 0.9).table(spark), ["variance", "cumulative"])


def _scores(spark, d):
    rows, _ = M.scale(space(spark, d), "score", center=True)
    return M.reduce_rows(rows.drop("score"), M.fit_pca(rows, "scaled", DIMS, k=4), "scaled").drop("scaled")


@query("kmeans_sweep_scores")
def kmeans_sweep_scores(spark, d):
    return rounded(C.sweep(_scores(spark, d), "score", range(2, 8), seed=1).table(spark), ["silhouette"])


@query("kmeans_labels")
def kmeans_labels(spark, d):
    s = _scores(spark, d)
    return C.sweep(s, "score", [5], seed=1).label(s).select("vec_id", "year", "prediction")


@query("kmeans_nearest_centres", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS misplaced FROM embeddings")
def kmeans_nearest_centres(spark, d):
    """Rows whose label is not that of the nearest centre: there are none."""
    s = _scores(spark, d)
    best = C.sweep(s, "score", [5], seed=1)
    centres = best.centres(spark).groupBy("prediction").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "centre"))), lambda p: p.centre).alias("centre"))
    every = centres.agg(F.collect_list(F.struct("prediction", "centre")).alias("c")).scalar()
    near = best.label(s.withColumn("values", F.col("score")).withColumn("c", F.explode(every)))
    near = near.select("vec_id", "prediction", euclidean_arrays("values", "c.centre").alias("gap"), F.col("c.prediction").alias("other"))
    nearest = near.groupBy("vec_id", "prediction").agg(F.min_by("other", "gap").alias("nearest"))
    return nearest.agg(F.count("*").alias("rows"), F.count_if(F.col("nearest") != F.col("prediction")).alias("misplaced"))


@query("kmeans_seed_stability")
def kmeans_seed_stability(spark, d):
    return rounded(C.stability_table(C.stable_sweep(_scores(spark, d), "score", range(2, 5), (1, 2)).table(spark)), ["mean_silhouette", "variance"])


@query("kmeans_sampled_silhouette")
def kmeans_sampled_silhouette(spark, d):
    out = C.sweep(_scores(spark, d), "score", range(2, 5), seed=42, sample_keys=["vec_id"])
    return rounded(out.table(spark), ["silhouette"])


@query("bisecting_kmeans_sweep")
def bisecting_kmeans_sweep(spark, d):
    return rounded(C.sweep(_scores(spark, d), "score", range(2, 7), kind="bisecting").table(spark), ["silhouette"])


@query("cluster_centres")
def cluster_centres(spark, d):
    return rounded(C.sweep(_scores(spark, d), "score", [4], seed=1).centres(spark), ["centre"])


@query("features_to_cluster_sizes")
def features_to_cluster_sizes(spark, d):
    rows, _ = M.scale(tracks(spark, d), FEATURES)
    scored = M.reduce_rows(rows, M.fit_pca(rows, "scaled", len(FEATURES), 0.9), "scaled").select("year", "artist", "score")
    # The table comes in a single split: spread it for the k-means passes.
    best = C.sweep(scored, "score", [3], seed=1, partitions=spark.sparkContext.defaultParallelism)
    return cluster_sizes(best.label(scored))


_DBSCAN = f"""WITH RECURSIVE {SPACE_SQL},
z AS (SELECT vec_id, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS y FROM space),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM z a JOIN z b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {{eps}} * {{eps}}),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {{m}}),
link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(a, b) AS (SELECT id, id FROM core UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
comp AS (SELECT a AS id, min(b) AS first FROM reach GROUP BY a),
num AS (SELECT first, row_number() OVER (ORDER BY first) - 1 AS cluster FROM (SELECT DISTINCT first FROM comp)),
lab AS (SELECT id, cluster FROM comp JOIN num USING (first)),
edge AS (SELECT near.a AS id, min(cluster) AS cluster FROM near JOIN lab ON lab.id = near.b WHERE near.a NOT IN (SELECT id FROM core) GROUP BY near.a),
labels AS (SELECT vec_id, CAST(coalesce(lab.cluster, edge.cluster, -1) AS INTEGER) AS cluster
           FROM z LEFT JOIN lab ON lab.id = vec_id LEFT JOIN edge ON edge.id = vec_id)"""


@query("dbscan_labels", _DBSCAN.format(eps=0.2, m=5) + " SELECT vec_id, cluster FROM labels")
def dbscan_labels(spark, d):
    return D.dbscan(space(spark, d), "vec_id", "score", 0.2, 5, DIMS).select("vec_id", "cluster")


@query("dbscan_wide_radius", _DBSCAN.format(eps=0.45, m=30) + " SELECT cluster, count(*) AS n FROM labels GROUP BY cluster")
def dbscan_wide_radius(spark, d):
    out = D.dbscan(space(spark, d), "vec_id", "score", 0.45, 30, DIMS)
    return out.groupBy("cluster").agg(F.count("*").alias("n"))


# The same labels for four settings at once, with the squared-distance silhouette over all pairs.
_SWEEP = f"""WITH RECURSIVE {SPACE_SQL},
z AS (SELECT vec_id, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS y FROM space),
set AS (SELECT eps, m FROM (VALUES (0.2::DOUBLE), (0.3::DOUBLE)) e(eps) CROSS JOIN (VALUES (5), (10)) k(m)),
near AS (SELECT eps, m, a.vec_id AS a, b.vec_id AS b FROM set, z a, z b WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= eps * eps),
core AS (SELECT eps, m, a AS id FROM near GROUP BY eps, m, a HAVING count(*) >= m),
link AS (SELECT eps, m, a, b FROM near SEMI JOIN core c1 ON c1.eps = near.eps AND c1.m = near.m AND c1.id = near.a
         SEMI JOIN core c2 ON c2.eps = near.eps AND c2.m = near.m AND c2.id = near.b),
reach(eps, m, a, b) AS (SELECT eps, m, id, id FROM core UNION
  SELECT r.eps, r.m, r.a, l.b FROM reach r JOIN link l ON l.eps = r.eps AND l.m = r.m AND l.a = r.b),
lab AS (SELECT eps, m, a AS id, min(b) AS cluster FROM reach GROUP BY eps, m, a),
edge AS (SELECT n.eps, n.m, n.a AS id, min(cluster) AS cluster FROM near n JOIN lab l ON l.eps = n.eps AND l.m = n.m AND l.id = n.b GROUP BY n.eps, n.m, n.a),
labels AS (SELECT set.eps, set.m, z.vec_id AS id, x, y, coalesce(lab.cluster, edge.cluster, -1) AS cluster
  FROM set CROSS JOIN z LEFT JOIN lab ON lab.eps = set.eps AND lab.m = set.m AND lab.id = z.vec_id
  LEFT JOIN edge ON edge.eps = set.eps AND edge.m = set.m AND edge.id = z.vec_id),
far AS (SELECT p.eps, p.m, p.id, p.cluster AS own, o.cluster AS other, sum(pow(p.x - o.x, 2) + pow(p.y - o.y, 2)) AS d, count(*) AS n
        FROM labels p JOIN labels o ON o.eps = p.eps AND o.m = p.m GROUP BY ALL),
ab AS (SELECT eps, m, id, max(n) FILTER (WHERE own = other) AS size, max(d / nullif(n - 1, 0)) FILTER (WHERE own = other) AS a,
              min(d / n) FILTER (WHERE own <> other) AS b FROM far GROUP BY eps, m, id),
sil AS (SELECT eps, m, avg(CASE WHEN size = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab GROUP BY eps, m)
SELECT labels.eps, CAST(labels.m AS INTEGER) AS min_samples, round(max(silhouette), 5) AS silhouette,
       count(DISTINCT cluster) FILTER (WHERE cluster >= 0) AS n_clusters, round(avg(CASE WHEN cluster < 0 THEN 1.0 ELSE 0.0 END), 5) AS noise_ratio
FROM labels JOIN sil ON sil.eps = labels.eps AND sil.m = labels.m GROUP BY labels.eps, labels.m"""


@query("dbscan_parameter_sweep", _SWEEP)
def dbscan_parameter_sweep(spark, d):
    return rounded(D.dbscan_sweep(space(spark, d), "vec_id", "score", [0.2, 0.3], [5, 10], DIMS), ["silhouette", "noise_ratio"], 5)


_LINKAGE = f"""WITH RECURSIVE {SPACE_SQL},
z AS (SELECT vec_id, year, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS y FROM space),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM z a JOIN z b ON {{same}} AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {{height}} * {{height}}),
reach(a, b) AS (SELECT vec_id, vec_id FROM z UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b)
"""


@query("hierarchical_distance_cut", _LINKAGE.format(same="true", height="0.15::DOUBLE") + "SELECT a AS vec_id, min(b) AS cluster FROM reach GROUP BY a")
def hierarchical_distance_cut(spark, d):
    return H.single_linkage(space(spark, d), "vec_id", "score", 0.15, dims=DIMS).select("vec_id", "cluster")


@query("hierarchical_label_totals", _LINKAGE.format(same="true", height="0.1::DOUBLE") +
       "SELECT cluster, count(*) AS n FROM (SELECT a, min(b) AS cluster FROM reach GROUP BY a) GROUP BY cluster")
def hierarchical_label_totals(spark, d):
    return H.single_linkage(space(spark, d), "vec_id", "score", 0.1, dims=DIMS).groupBy("cluster").agg(F.count("*").alias("n"))


@query("hierarchical_by_year", _LINKAGE.format(same="a.year = b.year", height="0.5::DOUBLE") +
       "SELECT z.year, a AS vec_id, min(b) AS cluster FROM reach JOIN z ON z.vec_id = a GROUP BY ALL")
def hierarchical_by_year(spark, d):
    return H.single_linkage(space(spark, d), "vec_id", "score", 0.5, by=["year"], dims=DIMS).select("year", "vec_id", "cluster")


# Tracks of one artist by two features: the same part stands under several artists.
_BY_ARTIST = f"""WITH RECURSIVE {TRACK_SQL},
z AS (SELECT artist, name, (q - avg(q) OVER ()) / stddev_samp(q) OVER () AS x, (p - avg(p) OVER ()) / stddev_samp(p) OVER () AS y FROM tracks),
s AS (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY x, y, name) AS i FROM z),
near AS (SELECT a.artist, a.i AS a, b.i AS b FROM s a JOIN s b ON a.artist = b.artist AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.3::DOUBLE * 0.3),
reach(artist, a, b) AS (SELECT artist, i, i FROM s UNION SELECT r.artist, r.a, n.b FROM reach r JOIN near n ON n.artist = r.artist AND n.a = r.b),
low AS (SELECT artist, a AS i, min(b) AS root FROM reach GROUP BY artist, a),
named AS (SELECT artist, root, min(name) AS cluster FROM low JOIN s USING (artist, i) GROUP BY artist, root)
SELECT artist, name, cluster, count(*) AS n FROM low JOIN s USING (artist, i) JOIN named USING (artist, root) GROUP BY ALL"""


@query("hierarchical_by_artist", _BY_ARTIST)
def hierarchical_by_artist(spark, d):
    out = H.single_linkage(tracks(spark, d), "name", ["q", "p"], 0.3, by=["artist"], standardize=True)
    return out.groupBy("artist", "name", "cluster").agg(F.count("*").alias("n"))


# Prim's method row by row: every step moves the place nearest to the tree into it; its distance is a merge height.
_TREE = f"""WITH RECURSIVE {SPACE_SQL},
z AS (SELECT vec_id, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS y FROM space),
prim(step, id, x, y, near, d) AS (
  SELECT 1, z.vec_id, z.x, z.y, f.vec_id, sqrt((z.x - f.x) * (z.x - f.x) + (z.y - f.y) * (z.y - f.y))
  FROM z, (SELECT * FROM z ORDER BY vec_id LIMIT 1) f WHERE z.vec_id <> f.vec_id
  UNION ALL
  SELECT step + 1, id, x, y, CASE WHEN g < d THEN mid ELSE near END, least(d, g)
  FROM (SELECT *, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS g FROM (
    SELECT *, first_value(id) OVER w AS mid, first_value(x) OVER w AS mx, first_value(y) OVER w AS my FROM prim WINDOW w AS (ORDER BY d, id)
  )) WHERE id <> mid
), edge AS (SELECT arg_min(id, (d, id)) AS a, arg_min(near, (d, id)) AS b, min(d) AS height FROM prim GROUP BY step),
h AS (SELECT height, row_number() OVER (ORDER BY height) AS step FROM edge)"""
_CUT = """, link AS (SELECT a, b FROM edge, cut WHERE height <= h UNION ALL SELECT b, a FROM edge, cut WHERE height <= h),
reach(a, b) AS (SELECT vec_id, vec_id FROM z UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT a AS vec_id, min(b) AS cluster FROM reach GROUP BY a"""
_JUMP = "jump AS (SELECT step - 1 AS before, next - height AS jump FROM (SELECT *, lead(height) OVER (ORDER BY step) AS next FROM h) WHERE next IS NOT NULL ORDER BY jump DESC, step LIMIT 1)"


def _tree(spark, d):
    return H.linkage_tree(space(spark, d), "vec_id", "score", dims=DIMS)


@query("linkage_heights", _TREE + " SELECT step, round(height, 6) AS height FROM h")
def linkage_heights(spark, d):
    return rounded(_tree(spark, d).ordered_heights().drop("grp"), ["height"])


@query("linkage_largest_jump", f"{_TREE}, {_JUMP} SELECT before, round(jump, 6) AS jump FROM jump")
def linkage_largest_jump(spark, d):
    return rounded(_tree(spark, d).largest_jump().drop("grp"), ["jump"])


@query("hierarchical_cut_by_count", _TREE + ", cut AS (SELECT max(height) AS h FROM h WHERE step <= (SELECT count(*) FROM z) - 12)" + _CUT)
def hierarchical_cut_by_count(spark, d):
    return _tree(spark, d).cut_by_count(12).select("vec_id", "cluster")


@query("hierarchical_cut_largest_jump", f"{_TREE}, {_JUMP}, cut AS (SELECT coalesce(max(height), 0) AS h FROM h, jump WHERE step <= before)" + _CUT)
def hierarchical_cut_largest_jump(spark, d):
    return _tree(spark, d).cut_at_largest_jump().select("vec_id", "cluster")


@query("hierarchical_cut_mean_deviation", _TREE + ", cut AS (SELECT avg(height) + stddev_pop(height) AS h FROM h)" + _CUT)
def hierarchical_cut_mean_deviation(spark, d):
    return _tree(spark, d).cut_by_deviation().select("vec_id", "cluster")
