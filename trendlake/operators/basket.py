"""Frequent item sets, rules and the graph of single-item rules."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlake.functions.lists import item_label


def baskets(df: DataFrame, key: str, item: str, name: str = "items") -> DataFrame:
    """One de-duplicated item list per key, in one shuffle."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias(name))


def mine(df: DataFrame, items: str, min_support: float = 0.005, min_confidence: float = 0.4) -> FPGrowthModel:
    """FP-Growth over item lists. Repeated items in a list count once; null lists are ignored,
    empty lists count towards the number of baskets."""
    lists = df.select(F.array_distinct(items).alias("items")).filter(F.col("items").isNotNull())
    return FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(lists)


def frequent_itemsets(model: FPGrowthModel) -> DataFrame:
    """``items, freq``, largest frequency first."""
    return model.freqItemsets.withColumn("items", F.array_sort("items")).orderBy(F.desc("freq"), "items")


def association_rules(model: FPGrowthModel) -> DataFrame:
    """``antecedent, consequent, confidence, lift, support``, largest confidence first."""
    rules = model.associationRules.withColumn("antecedent", F.array_sort("antecedent"))
    return rules.orderBy(F.desc("confidence"), F.desc("lift"), "antecedent", "consequent")


def top_itemsets(itemsets: DataFrame, size: int, n: int = 20) -> DataFrame:
    """The ``n`` most frequent sets of one size, with a label."""
    label = item_label("items")
    return (
        itemsets.filter(F.size("items") == size).withColumn("label", label)
        .orderBy(F.desc("freq"), "label").limit(n).select("label", "freq")
    )


def rule_edges(rules: DataFrame, min_confidence: float = 0.4, n: int | None = None) -> DataFrame:
    """``source, target, weight, lift`` of the rules with one item on each side, the ``n`` most confident ones if given."""
    one_to_one = (F.size("antecedent") == 1) & (F.size("consequent") == 1)
    edges = (
        rules.filter(one_to_one & (F.col("confidence") >= min_confidence))
        .select(
            F.get("antecedent", F.lit(0)).alias("source"), F.get("consequent", F.lit(0)).alias("target"),
            F.col("confidence").alias("weight"), "lift",
        )
        .orderBy(F.desc("weight"), "source", "target")
    )
    return edges if n is None else edges.limit(n)


def node_degrees(edges: DataFrame) -> DataFrame:
    """``node, degree``: rules leaving plus rules reaching each item."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))
