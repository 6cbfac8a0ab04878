"""Scans and sinks. CSV files are written from the given tables first, then read back."""

from pyspark.sql import functions as F

from trendlake.queries.base import query, r, scratch, space, table
from trendlake.sources.files import (
    chart_extract, exclude_ids, hash_sample, hash_split, labelled_ids, read_csv, read_table, read_timed_csv, write_csv,
)


@query("csv_scan", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders""")
def csv_scan(spark, d):
    path = scratch(spark, "csv")
    columns = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    write_csv(table(spark, d, "orders", *columns), path)
    return read_csv(spark, path, columns)


@query("column_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem")
def column_pruned_scan(spark, d):
    return read_table(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("yearly_csv_files", """
SELECT CAST(o_orderdate AS VARCHAR)[1:10] AS ts, round(o_totalprice, 2) AS total FROM orders""")
def yearly_csv_files(spark, d):
    path = scratch(spark, "yearly")
    orders = table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("o_totalprice").alias("total"),
        F.year("o_orderdate").alias("part"),
    )
    orders.write.partitionBy("part").csv(path, header=True)
    read = read_timed_csv(spark, f"{path}/part=*", ["total"])
    return read.select(F.date_format("ts", "yyyy-MM-dd").alias("ts"), r("total", 2).alias("total"))


@query("timed_csv", """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value FROM events""")
def timed_csv(spark, d):
    path = scratch(spark, "timed")
    write_csv(table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "value"), path)
    return read_timed_csv(spark, path, ["value"]).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("single_file_csv", """
SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier""")
def single_file_csv(spark, d):
    path = scratch(spark, "single")
    write_csv(table(spark, d, "supplier", "s_suppkey", "s_name"), path, single_file=True)
    return read_csv(spark, path, ["s_suppkey", "s_name"])


@query("labelled_id_export", """
SELECT CAST(vec_id AS VARCHAR) AS vec_id, 'removed' AS label FROM embeddings WHERE label = 3""")
def labelled_id_export(spark, d):
    path = scratch(spark, "ids")
    write_csv(labelled_ids(space(spark, d), 3, "removed", key="vec_id"), path)
    return read_csv(spark, path, ["vec_id", "label"])


@query("exclusion_list", """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def exclusion_list(spark, d):
    toxic = table(spark, d, "labels").filter("toxic = 1")
    return exclude_ids(table(spark, d, "documents", "doc_id", "lang"), toxic, "doc_id")


@query("summary_table_export", """
SELECT CAST(l_returnflag AS VARCHAR) AS flag, CAST(count(*) AS VARCHAR) AS n FROM lineitem GROUP BY 1""")
def summary_table_export(spark, d):
    path = scratch(spark, "summary")
    write_csv(table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n")), path)
    return read_csv(spark, path, ["flag", "n"])


@query("trend_reference_import", """
SELECT source, round(avg(n_chars), 4) AS mean_chars, count(*) AS n FROM documents GROUP BY source""")
def trend_reference_import(spark, d):
    path = scratch(spark, "trend")
    write_csv(table(spark, d, "documents", "doc_id", "source", "n_chars"), path)
    rows = read_csv(spark, path, ["doc_id", "source", "n_chars"])
    return rows.groupBy("source").agg(r(F.avg(F.col("n_chars").try_cast("double")), 4).alias("mean_chars"), F.count("*").alias("n"))


@query("artist_extract", """
SELECT l_orderkey, l_partkey, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem WHERE l_suppkey = 7""")
def artist_extract(spark, d):
    rows = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    return chart_extract(rows, "l_shipdate", artist=7, artist_col="l_suppkey").select("l_orderkey", "l_partkey", "year")


@query("sampled_extract")
def sampled_extract(spark, d):
    rows = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    return chart_extract(rows, "o_orderdate", fraction=0.1, seed=42).select("o_orderkey", "year")


@query("hash_sample_by_key")
def hash_sample_by_key(spark, d):
    return hash_sample(table(spark, d, "orders", "o_orderkey", "o_totalprice"), ["o_orderkey"], 0.1, 42)


@query("random_split_halves", "SELECT count(*) AS all_rows, CAST(0 AS BIGINT) AS lost FROM orders")
def random_split_halves(spark, d):
    orders = table(spark, d, "orders", "o_orderkey")
    a, b = hash_split(orders, ["o_orderkey"], 0.5, 42)
    both = a.withColumn("part", F.lit("a")).unionByName(b.withColumn("part", F.lit("b")))
    parts = both.groupBy("o_orderkey").agg(F.count("*").alias("rows"), F.count_distinct("part").alias("parts"))
    return parts.agg(
        F.sum("rows").cast("bigint").alias("all_rows"), F.count_if(F.col("parts") != 1).alias("lost")
    )
