"""Canonical frames over the star-schema tables (definitions: FIXTURES.md part 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.session import use_utc

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "timestamp", "amount"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def transfers(spark: SparkSession, sf_dir: str, orders_first: bool = False) -> DataFrame:
    """Canonical transactions; join strategies are left to Catalyst and AQE.

    ``orders_first`` gives the same rows in other partitions: orders meet their customers before the lines
    come, so that large customers do not make the lines move again.
    """
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    supplier = table(spark, sf_dir, "supplier")
    flagged = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)
    # lines go to the joins with the flag, not with the text it is made of
    line = line.withColumn("_flagged", F.when(flagged, 1).otherwise(0))
    of_order, of_customer = F.col("l_orderkey") == F.col("o_orderkey"), F.col("o_custkey") == F.col("c_custkey")
    if orders_first:
        known = line.join(orders.join(customer, of_customer), of_order)
    else:
        known = line.join(orders, of_order).join(customer, of_customer)
    return (
        known.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            F.col("l_shipdate").alias("timestamp"),
            F.col("c_nationkey").alias("from_bank"),
            F.col("o_custkey").alias("source"),
            F.col("s_nationkey").alias("to_bank"),
            F.col("l_suppkey").alias("target"),
            F.col("l_extendedprice").alias("amount"),
            F.col("o_orderpriority").alias("payment_format"),
            F.col("_flagged").alias("is_fraud"),
            "l_quantity",
            "l_discount",
            "l_tax",
        )
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers with a deterministic score full of ties, and a second model's score."""
    points = (
        F.round(F.col("l_discount") * 100).cast("int") * 50
        + F.round(F.col("l_tax") * 100).cast("int") * 25
        + F.col("l_quantity").cast("int")
    )
    return (
        transfers(spark, sf_dir)
        .withColumn("score_int", points)
        .withColumn("score", F.col("score_int") / F.lit(750.0))
        .withColumn("score_b", F.col("l_quantity").cast("int") / F.lit(50.0))
        .withColumnRenamed("is_fraud", "label")
    )


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``scores`` that need no join: read from lineitem alone."""
    line = table(spark, sf_dir, "lineitem")
    flagged = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)
    points = (
        F.round(F.col("l_discount") * 100).cast("int") * 50
        + F.round(F.col("l_tax") * 100).cast("int") * 25
        + F.col("l_quantity").cast("int")
    )
    return line.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_extendedprice").alias("amount"),
        F.when(flagged, 1).otherwise(0).alias("label"),
        points.alias("score_int"),
        (points / F.lit(750.0)).alias("score"),
        (F.col("l_quantity").cast("int") / F.lit(50.0)).alias("score_b"),
    )


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")


def pattern_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fraud rows with a typology: stand-in for parsed pattern transactions."""
    kind = F.col("l_orderkey") % 4
    return (
        transfers(spark, sf_dir)
        .filter(F.col("is_fraud") == 1)
        .withColumn(
            "pattern_type",
            F.when(kind == 0, "FAN-OUT").when(kind == 1, "CYCLE").when(kind == 2, "GATHER-SCATTER").otherwise("STACK"),
        )
    )
