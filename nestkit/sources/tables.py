"""Tables as Parquet under one folder, and documents nested from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc, value: each order with its lines as an array of structs, in the order of their fields."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc"),
        F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("off"), F.col("l_returnflag").alias("flag")).alias("line"),
    )
    packed = lines.groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderkey", "doc").join(packed, "doc")
    return orders.select("doc", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), "lines", F.col("o_orderpriority").alias("priority")).alias("value"))


def customer_values(spark: SparkSession, folder: str) -> DataFrame:
    """doc, value: each customer as a struct of scalars and a struct."""
    c = table(spark, folder, "customer")
    inner = F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return c.select(F.col("c_custkey").alias("doc"), F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), inner.alias("of"), F.lit(None).cast("string").alias("note")).alias("value"))


def region_values(spark: SparkSession, folder: str) -> DataFrame:
    """doc, value: each region with its nations."""
    nations = table(spark, folder, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))).alias("nations"))
    return table(spark, folder, "region").join(nations, "r_regionkey").select(F.col("r_regionkey").cast("long").alias("doc"), F.struct(F.col("r_name").alias("name"), "nations").alias("value"))
