"""Instance tables made from order data: a customer or supplier is an instance, an order priority an algorithm, its mean price a cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .metadata import Instances

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
ALGOS = tuple(f"algo_p{i}" for i in range(1, 6))
CUSTOMER_FEATURES = ("feature_n_orders", "feature_avg_price", "feature_std_price", "feature_avg_qty", "feature_avg_disc", "feature_avg_tax", "feature_acctbal")
SUPPLIER_FEATURES = ("feature_n_items", "feature_avg_qty", "feature_avg_disc", "feature_avg_tax", "feature_acctbal")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str) -> Column:
    """Hundredths as a whole number, so that sums do not depend on their order."""
    return F.round(F.col(c) * 100).cast("long")


def mean(sum_cents: Column, n: Column) -> Column:
    """Mean from a sum of hundredths; null where n is 0."""
    return F.when(n > 0, sum_cents.cast("double") / n.cast("double") / F.lit(100.0))


def _priority_means(value: str) -> list[Column]:
    out = []
    for a, p in zip(ALGOS, PRIORITIES, strict=True):
        mine = F.col("o_orderpriority") == p
        out.append(mean(F.sum(F.when(mine, F.col(value))), F.count(F.when(mine, F.col(value)))).alias(a))
    return out


def customer_instances(spark: SparkSession, sf_dir: str) -> Instances:
    """Lines are summed by order before the join, so the join has one row an order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(cents("l_quantity")).alias("_qty"), F.sum(cents("l_discount")).alias("_disc"), F.sum(cents("l_tax")).alias("_tax"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", cents("o_totalprice").alias("_p"))
    n, s = F.count("_p"), F.sum("_p").cast("double")
    square = F.sum(F.col("_p").cast("decimal(38,0)") * F.col("_p")).cast("double")
    items = F.sum("_n")
    of = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").groupBy("o_custkey").agg(
        n.cast("double").alias("feature_n_orders"), mean(F.sum("_p"), n).alias("feature_avg_price"),
        F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (square - s * s / n) / (n - 1))) / 100.0).alias("feature_std_price"),
        mean(F.sum("_qty"), items).alias("feature_avg_qty"), mean(F.sum("_disc"), items).alias("feature_avg_disc"), mean(F.sum("_tax"), items).alias("feature_avg_tax"), *_priority_means("_p"))
    c = table(spark, sf_dir, "customer")
    df = c.join(of, c["c_custkey"] == of["o_custkey"], "left").select(
        F.col("c_custkey").alias("iid"), F.col("c_custkey").cast("string").alias("instances"), F.col("c_mktsegment").alias("source"),
        *[f for f in CUSTOMER_FEATURES if f != "feature_acctbal"], F.col("c_acctbal").alias("feature_acctbal"), *ALGOS)
    return Instances(df, CUSTOMER_FEATURES, ALGOS)


def supplier_instances(spark: SparkSession, sf_dir: str) -> Instances:
    """Lines and orders are merged at every size: small orders would else be broadcast, so the driver held them and what is shuffled leapt as they grew."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", cents("l_extendedprice").alias("_p"), cents("l_quantity").alias("_qty"), cents("l_discount").alias("_disc"), cents("l_tax").alias("_tax"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    n = F.count(F.lit(1))
    of = lines.join(orders.hint("merge"), lines["l_orderkey"] == orders["o_orderkey"]).groupBy("l_suppkey").agg(
        n.cast("double").alias("feature_n_items"), mean(F.sum("_qty"), n).alias("feature_avg_qty"), mean(F.sum("_disc"), n).alias("feature_avg_disc"), mean(F.sum("_tax"), n).alias("feature_avg_tax"), *_priority_means("_p"))
    c = table(spark, sf_dir, "supplier")
    df = c.join(of, c["s_suppkey"] == of["l_suppkey"], "left").select(
        F.col("s_suppkey").alias("iid"), F.col("s_suppkey").cast("string").alias("instances"), F.col("s_nationkey").cast("string").alias("source"),
        *[f for f in SUPPLIER_FEATURES if f != "feature_acctbal"], F.col("s_acctbal").alias("feature_acctbal"), *ALGOS)
    return Instances(df, SUPPLIER_FEATURES, ALGOS)
