"""Casting, filtering, scaling and list-text queries."""

from pyspark.sql import functions as F

from trendlake.functions.dates import date_parts, parse_date, window_start, year_prefix
from trendlake.functions.lists import item_label, parse_list_json, parse_list_plain, parse_list_strict
from trendlake.functions.terms import fourier_terms, percent, ramp_from, step_from
from trendlake.functions.vectors import array_to_vector, euclidean_arrays, vector_to_array
from trendlake.operators import clean as C
from trendlake.queries.base import (
    LITERAL_SQL, SPACE_SQL, TRACK_SQL, literals, query, r, rounded, space, table, tracks,
)

# Order rows as text with every seventh price unreadable.
MESSY_SQL = """messy AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS price,
         CASE WHEN o_orderkey % 11 = 0 THEN '4.7' ELSE CAST(o_custkey AS VARCHAR) END AS cust,
         CASE WHEN o_orderstatus = 'F' THEN 'true' WHEN o_orderstatus = 'O' THEN 'false' ELSE 'maybe' END AS flag,
         CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m')
              WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'unknown' END AS day
  FROM orders)"""
DAY_SQL = """CASE id % 4 WHEN 0 THEN day || '-01-01' WHEN 1 THEN day || '-01' WHEN 2 THEN day ELSE NULL END"""


def messy(spark, d):
    o = table(spark, d, "orders")
    date = F.col("o_orderdate")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("id"),
        F.when(key % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(key % 11 == 0, "4.7").otherwise(F.col("o_custkey").cast("string")).alias("cust"),
        F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "O", "false").otherwise("maybe").alias("flag"),
        F.when(key % 4 == 0, F.date_format(date, "yyyy")).when(key % 4 == 1, F.date_format(date, "yyyy-MM"))
        .when(key % 4 == 2, F.date_format(date, "yyyy-MM-dd")).otherwise("unknown").alias("day"),
    )


@query("typed_casts", f"""
WITH {MESSY_SQL}
SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE CAST(cust AS INTEGER) END AS cust,
       CASE flag WHEN 'true' THEN 1 WHEN 'false' THEN 0 END AS flag,
       round(TRY_CAST(price AS DOUBLE), 2) AS price, {DAY_SQL} AS day FROM messy""")
def typed_casts(spark, d):
    t = C.cast_columns(messy(spark, d), ints=["cust"], booleans=["flag"], doubles=["price"], dates=["day"])
    return t.withColumns({"flag": F.col("flag").cast("int"), "price": r("price", 2), "day": F.col("day").cast("string")})


@query("partial_date_parse", f"""
WITH {MESSY_SQL} SELECT {DAY_SQL} AS day, count(*) AS n FROM messy GROUP BY 1""")
def partial_date_parse(spark, d):
    return messy(spark, d).groupBy(parse_date("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("feature_selection", f"""
WITH {MESSY_SQL} SELECT id, round(TRY_CAST(price AS DOUBLE), 2) AS f0, round(TRY_CAST(cust AS DOUBLE), 2) AS f1
FROM messy WHERE TRY_CAST(price AS DOUBLE) IS NOT NULL""")
def feature_selection(spark, d):
    out = C.select_features(messy(spark, d), ["id"], ["price", "cust"])
    return out.select("id", r(F.col("raw_features")[0], 2).alias("f0"), r(F.col("raw_features")[1], 2).alias("f1"))


@query("drop_incomplete_rows", f"""
WITH {MESSY_SQL} SELECT id FROM messy WHERE TRY_CAST(price AS DOUBLE) IS NOT NULL""")
def drop_incomplete_rows(spark, d):
    return C.drop_incomplete(C.cast_columns(messy(spark, d), doubles=["price"]), ["price"]).select("id")


@query("date_range_filter", """
SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-02-01' AND o_orderdate < DATE '1999-07-01'""")
def date_range_filter(spark, d):
    return C.date_range(table(spark, d, "orders"), "o_orderdate", "1996-02-01", "1999-06-30").select("o_orderkey")


@query("date_range_as_text", f"""
WITH {MESSY_SQL} SELECT id FROM messy WHERE day BETWEEN '1996-01-01' AND '2000-12-31'""")
def date_range_as_text(spark, d):
    return C.date_range(messy(spark, d), "day", "1996-01-01", "2000-12-31", as_text=True).select("id")


@query("year_range_filter", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) >= 1998")
def year_range_filter(spark, d):
    return C.year_range(table(spark, d, "orders"), "o_orderdate", first=1998).select("o_orderkey")


@query("membership_filter", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_suppkey IN (3, 5, 8)")
def membership_filter(spark, d):
    return C.members(table(spark, d, "lineitem"), "l_suppkey", [3, 5, 8]).select("l_orderkey", "l_partkey")


@query("substring_filter", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')")
def substring_filter(spark, d):
    return C.containing(table(spark, d, "part", "p_partkey", "p_name"), "p_name", "ring")


@query("substring_share", """
SELECT count(*) FILTER (WHERE contains(p_name, 'ring')) AS matching, count(*) AS total,
       round(100.0 * count(*) FILTER (WHERE contains(p_name, 'ring')) / count(*), 2) AS percentage FROM part""")
def substring_share(spark, d):
    return C.containing_share(table(spark, d, "part"), "p_name", "ring")


@query("equality_lookup", "SELECT event_id, value FROM events WHERE event_type = 'click' AND user_id = 8")
def equality_lookup(spark, d):
    return C.equal_to(table(spark, d, "events"), event_type="click", user_id=8).select("event_id", "value")


@query("score_box", """
SELECT vec_id FROM embeddings WHERE list_min(embedding) >= -0.3 AND list_max(embedding) <= 0.3""")
def score_box(spark, d):
    return C.score_box(space(spark, d), "score", -0.3, 0.3).select("vec_id")


@query("rename_and_drop", "SELECT p_partkey AS part_id, p_name AS name FROM part")
def rename_and_drop(spark, d):
    t = table(spark, d, "part", "p_partkey", "p_name", "p_brand")
    return C.rename_drop(t, {"p_partkey": "part_id", "p_name": "name"}, drop=["p_brand"])


@query("year_by_substring", f"""
WITH {MESSY_SQL} SELECT TRY_CAST(substr(day, 1, 4) AS INTEGER) AS year, count(*) AS n FROM messy GROUP BY 1""")
def year_by_substring(spark, d):
    return messy(spark, d).groupBy(year_prefix("day").alias("year")).agg(F.count("*").alias("n"))


@query("mean_imputation", f"""
WITH {MESSY_SQL}, t AS (SELECT id, TRY_CAST(price AS DOUBLE) AS price FROM messy)
SELECT id, round(coalesce(price, (SELECT avg(price) FROM t)), 2) AS price FROM t""")
def mean_imputation(spark, d):
    return C.impute_mean(messy(spark, d).select("id", "price"), ["price"]).select("id", r("price", 2).alias("price"))


_FENCE = """SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
  quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {t}"""


def _priced(spark, d):
    # Squares give both columns a long upper tail.
    return table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") * F.col("o_totalprice") / 1e8).alias("a"),
        (F.col("o_custkey") * F.col("o_custkey") * F.col("o_custkey") / 1000.0).alias("b"))


_PRICED = """t0 AS (SELECT o_orderkey, o_totalprice * o_totalprice / 1e8 AS a,
  o_custkey * o_custkey * o_custkey / 1000.0 AS b FROM orders)"""


@query("outliers_sequential", f"""
WITH {_PRICED}, fa AS ({_FENCE.format(c='a', t='t0')}),
t1 AS (SELECT t0.* FROM t0, fa WHERE a BETWEEN lo AND hi), fb AS ({_FENCE.format(c='b', t='t1')})
SELECT o_orderkey FROM t1, fb WHERE b BETWEEN lo AND hi""")
def outliers_sequential(spark, d):
    return C.remove_outliers(_priced(spark, d), ["a", "b"]).select("o_orderkey")


@query("outliers_one_pass", f"""
WITH {_PRICED}, fa AS ({_FENCE.format(c='a', t='t0')}), fb AS ({_FENCE.format(c='b', t='t0')})
SELECT o_orderkey FROM t0, fa, fb WHERE a BETWEEN fa.lo AND fa.hi AND b BETWEEN fb.lo AND fb.hi""")
def outliers_one_pass(spark, d):
    return C.remove_outliers(_priced(spark, d), ["a", "b"], sequential=False).select("o_orderkey")


@query("clip_lower_bound", """
SELECT c_custkey, greatest(c_acctbal, 0.0) AS c_acctbal FROM customer""")
def clip_lower_bound(spark, d):
    return C.clip_lower(table(spark, d, "customer", "c_custkey", "c_acctbal"), ["c_acctbal"])


@query("period_slice", """
SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'""")
def period_slice(spark, d):
    return C.period_slice(table(spark, d, "events"), "ts", "2024-01-05", "2024-01-12").select("event_id")


@query("zscore_columns", """
SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 6) AS price_z
FROM orders""")
def zscore_columns(spark, d):
    t = C.zscore(table(spark, d, "orders", "o_orderkey", "o_totalprice"), ["o_totalprice"], suffix="_z")
    return t.select("o_orderkey", r("o_totalprice_z").alias("price_z"))


@query("minmax_global", """
SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 6) AS scaled
FROM orders""")
def minmax_global(spark, d):
    return C.minmax(table(spark, d, "orders", "o_orderkey", "o_totalprice"), ["o_totalprice"]).select(
        "o_orderkey", r("o_totalprice").alias("scaled"))


@query("minmax_per_metric", """
WITH long AS (
  SELECT doc_id, 'n_chars' AS metric, CAST(n_chars AS DOUBLE) AS v FROM documents
  UNION ALL SELECT doc_id, 'words', CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) FROM documents)
SELECT doc_id, metric, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) AS value
FROM long WINDOW w AS (PARTITION BY metric)""")
def minmax_per_metric(spark, d):
    blanks = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    t = table(spark, d, "documents").select("doc_id", "n_chars", blanks.alias("words"))
    return C.minmax_long(t, ["doc_id"], ["n_chars", "words"]).withColumn("value", r("value"))


@query("detail_listing", """
SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_suppkey = 4 ORDER BY l_extendedprice DESC""")
def detail_listing(spark, d):
    return C.detail_listing(
        table(spark, d, "lineitem"), ["l_orderkey", "l_extendedprice"], F.col("l_suppkey") == 4, "l_extendedprice")


@query("artist_timeline", f"""
WITH {TRACK_SQL}, t AS (SELECT * FROM tracks WHERE artist IN (3, 5))
SELECT artist, name, strftime(release_date, '%Y-%m-%d') AS release_date,
       round((q - min(q) OVER ()) / (max(q) OVER () - min(q) OVER ()), 6) AS q,
       round((p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER ()), 6) AS p FROM t""")
def artist_timeline(spark, d):
    t = C.artist_timeline(tracks(spark, d), [3, 5], "release_date", ["q", "p"], keep=["name"])
    return rounded(t, ["q", "p"]).withColumn("release_date", F.date_format("release_date", "yyyy-MM-dd"))


@query("extreme_scores", f"""
WITH {SPACE_SQL} SELECT vec_id, CAST(year AS INTEGER) AS year, round(x, 6) AS pc1, round(y, 6) AS pc2 FROM space WHERE y > 0.15""")
def extreme_scores(spark, d):
    s = space(spark, d).withColumn("day", F.concat(F.col("year").cast("string"), F.lit("-06-01")))
    return rounded(C.extreme_scores(s, ["vec_id"], "day", "score", 1, 0.15), ["pc1", "pc2"])


_ITEMS = "SELECT id, string_split(replace(replace(replace(genres, '[', ''), ']', ''), '''', ''), ', ') AS items FROM literals"


def _items(spark, d, parse):
    return literals(spark, d).select("id", F.array_join(parse("genres"), "|").alias("items"))


@query("list_text_strict", f"WITH {LITERAL_SQL} SELECT id, array_to_string(items, '|') AS items FROM ({_ITEMS})")
def list_text_strict(spark, d):
    return _items(spark, d, parse_list_strict)


@query("list_text_plain", f"WITH {LITERAL_SQL} SELECT id, array_to_string(items, '|') AS items FROM ({_ITEMS})")
def list_text_plain(spark, d):
    return _items(spark, d, parse_list_plain)


@query("list_text_json", f"WITH {LITERAL_SQL} SELECT id, array_to_string(items, '|') AS items FROM ({_ITEMS})")
def list_text_json(spark, d):
    return _items(spark, d, parse_list_json)


@query("exploded_items", f"WITH {LITERAL_SQL} SELECT id, unnest(items) AS item FROM ({_ITEMS})")
def exploded_items(spark, d):
    return literals(spark, d).select("id", F.explode(parse_list_json("genres")).alias("item"))


@query("array_access", """
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, len(embedding) AS dims,
       round(CAST(list_min(embedding) AS DOUBLE), 6) AS lowest, round(CAST(list_max(embedding) AS DOUBLE), 6) AS highest
FROM embeddings""")
def array_access(spark, d):
    s = F.col("score")
    return space(spark, d).select(
        "vec_id", r(F.get(s, F.lit(0))).alias("first"), F.size(s).cast("bigint").alias("dims"),
        r(F.array_min(s)).alias("lowest"), r(F.array_max(s)).alias("highest"))


@query("vector_round_trip", """
SELECT vec_id, round(CAST(embedding[64] AS DOUBLE), 6) AS last FROM embeddings""")
def vector_round_trip(spark, d):
    back = vector_to_array(array_to_vector(F.col("score").cast("array<double>")))
    return space(spark, d).select("vec_id", r(F.get(back, F.lit(63))).alias("last"))


@query("suffix_removal", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' Day' END AS holiday FROM part""")
def suffix_removal(spark, d):
    observed = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" (Observed)"))).otherwise(F.concat("p_name", F.lit(" Day")))
    t = table(spark, d, "part").select("p_partkey", observed.alias("holiday"))
    return t.withColumn("holiday", F.regexp_replace("holiday", r" \(Observed\)$", ""))


@query("item_set_label", f"""
WITH {LITERAL_SQL} SELECT id, array_to_string(items, ' , ') AS label FROM ({_ITEMS})""")
def item_set_label(spark, d):
    return literals(spark, d).select("id", item_label(parse_list_json("genres")).alias("label"))


@query("date_parts", """
SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
       CAST(dayofyear(ts) AS INTEGER) AS dayofyear, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
       CAST(hour(ts) AS INTEGER) AS hour, dayname(ts) AS weekday_name FROM events""")
def date_parts_of_events(spark, d):
    return table(spark, d, "events").select("event_id", *date_parts("ts"))


@query("distance_to_point", """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda e: pow(CAST(e AS DOUBLE) - 0.1, 2)))), 6) AS distance
FROM embeddings""")
def distance_to_point(spark, d):
    point = F.array_repeat(F.lit(0.1), 64)
    return space(spark, d).select("vec_id", r(euclidean_arrays(F.col("score").cast("array<double>"), point)).alias("distance"))


@query("standard_errors", f"""
WITH {TRACK_SQL} SELECT year, round(stddev_samp(q) / sqrt(count(q)), 6) AS se FROM tracks GROUP BY year""")
def standard_errors(spark, d):
    from trendlake.functions.terms import standard_error

    return tracks(spark, d).groupBy("year").agg(r(standard_error("q")).alias("se"))


@query("percent_of_total", """
SELECT lang, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 2) AS percentage FROM documents GROUP BY lang""")
def percent_of_total(spark, d):
    docs = table(spark, d, "documents", "lang")
    total = docs.agg(F.count("*").alias("n")).scalar()
    return docs.groupBy("lang").agg(F.count("*").alias("n")).select("lang", percent(F.col("n"), total).alias("percentage"))


@query("step_and_ramp", """
SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 1999 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS step,
       CAST(greatest(year(o_orderdate) - 1999, 0) AS DOUBLE) AS ramp FROM orders""")
def step_and_ramp(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", step_from("o_orderdate", 1999).alias("step"), ramp_from("o_orderdate", 1999).alias("ramp"))


@query("fourier_columns", """
WITH t AS (SELECT o_orderkey, 2 * pi() * date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) / 365.25 AS a FROM orders)
SELECT o_orderkey, round(sin(a), 6) + 0.0 AS year_sin1, round(cos(a), 6) + 0.0 AS year_cos1,
       round(sin(2 * a), 6) + 0.0 AS year_sin2, round(cos(2 * a), 6) + 0.0 AS year_cos2 FROM t""")
def fourier_columns(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", *fourier_terms("o_orderdate", 365.25, 2, "year"))
    return rounded(t, ["year_sin1", "year_cos1", "year_sin2", "year_cos2"])


@query("five_year_windows", """
SELECT CAST(floor(year(o_orderdate) / 5.0) * 5 AS INTEGER) AS window_start, count(*) AS n FROM orders GROUP BY 1""")
def five_year_windows(spark, d):
    return table(spark, d, "orders").groupBy(window_start(F.year("o_orderdate"), 5).alias("window_start")).agg(F.count("*").alias("n"))
