"""Item set and rule queries: the part types bought together in an order."""

from pyspark.sql import functions as F

from trendlake.operators import basket as B
from trendlake.queries.base import query, r, table

# Every subset of the six part types as a bit mask, counted against each order's mask.
_MASKS = """ty AS (SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT p_type FROM part)),
bask AS (SELECT l_orderkey, CAST(sum(bit) AS BIGINT) AS mask FROM (
  SELECT DISTINCT l_orderkey, CAST(1 AS BIGINT) << i AS bit FROM lineitem JOIN part ON l_partkey = p_partkey JOIN ty USING (p_type)) GROUP BY l_orderkey),
nb AS (SELECT count(*) AS n FROM bask),
sets AS (SELECT s, count(*) AS freq FROM range(1, 64) r(s) JOIN bask ON (mask & s) = s GROUP BY s),
freqs AS (SELECT s, freq, n FROM sets, nb WHERE freq >= ceil({support} * n)),
named AS (SELECT s, freq, n, count(*) AS size, string_agg(p_type, '|' ORDER BY p_type) AS items
          FROM freqs JOIN ty ON ((s >> i) & 1) = 1 GROUP BY s, freq, n),
rules AS (
  SELECT a.items AS antecedent, ty.p_type AS consequent, a.size, x.freq / a.freq AS confidence,
         x.freq / a.freq / (c.freq / x.n) AS lift, x.freq / x.n AS support
  FROM freqs x JOIN ty ON ((x.s >> i) & 1) = 1
  JOIN named a ON a.s = x.s - (CAST(1 AS BIGINT) << i) JOIN freqs c ON c.s = (CAST(1 AS BIGINT) << i)
  WHERE x.freq / a.freq >= {confidence})"""
SQL = _MASKS.format(support=0.005, confidence=0.1)


def _model(spark, d):
    bought = table(spark, d, "lineitem", "l_orderkey", "l_partkey").join(
        table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return B.mine(B.baskets(bought, "l_orderkey", "p_type"), "items", 0.005, 0.1)


@query("basket_sizes", f"""
WITH {SQL} SELECT bit_count(mask) AS size, count(*) AS n FROM bask GROUP BY 1""")
def basket_sizes(spark, d):
    bought = table(spark, d, "lineitem", "l_orderkey", "l_partkey").join(
        table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return B.baskets(bought, "l_orderkey", "p_type").groupBy(F.size("items").alias("size")).agg(F.count("*").alias("n"))


@query("frequent_itemsets", f"WITH {SQL} SELECT items, freq FROM named")
def frequent_itemsets(spark, d):
    return B.frequent_itemsets(_model(spark, d)).withColumn("items", F.array_join("items", "|"))


@query("association_rules", f"""
WITH {SQL} SELECT antecedent, consequent, round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(support, 6) AS support FROM rules""")
def association_rules(spark, d):
    return B.association_rules(_model(spark, d)).select(
        F.array_join("antecedent", "|").alias("antecedent"), F.get("consequent", F.lit(0)).alias("consequent"),
        r("confidence").alias("confidence"), r("lift").alias("lift"), r("support").alias("support"))


@query("top_itemsets_of_two", f"""
WITH {SQL} SELECT replace(items, '|', ' , ') AS label, freq FROM named WHERE size = 2 ORDER BY freq DESC, label LIMIT 20""")
def top_itemsets_of_two(spark, d):
    return B.top_itemsets(B.frequent_itemsets(_model(spark, d)), 2)


@query("top_itemsets_of_three", f"""
WITH {SQL} SELECT replace(items, '|', ' , ') AS label, freq FROM named WHERE size = 3 ORDER BY freq DESC, label LIMIT 20""")
def top_itemsets_of_three(spark, d):
    return B.top_itemsets(B.frequent_itemsets(_model(spark, d)), 3)


_EDGES = f"""{SQL}, edges AS (SELECT antecedent AS source, consequent AS target, confidence AS weight, lift FROM rules WHERE size = 1)"""


@query("rule_edges", f"""
WITH {_EDGES} SELECT source, target, round(weight, 6) AS weight, round(lift, 6) AS lift FROM edges""")
def rule_edges(spark, d):
    edges = B.rule_edges(B.association_rules(_model(spark, d)), 0.1)
    return edges.select("source", "target", r("weight").alias("weight"), r("lift").alias("lift"))


@query("rule_node_degrees", f"""
WITH {_EDGES} SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY node""")
def rule_node_degrees(spark, d):
    return B.node_degrees(B.rule_edges(B.association_rules(_model(spark, d)), 0.1))
