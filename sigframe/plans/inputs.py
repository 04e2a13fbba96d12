"""Panels made from the driver's tables: bars, snapshots, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.operators import features as W
from sigframe.operators.labels import label_snapshots
from sigframe.operators.temporal import nearest_ahead
from sigframe.session import table


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier-day bars; prices are whole cents, volumes whole numbers, so sums are exact."""
    k = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("date"), F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).alias("u"), k.alias("k"), F.col("l_quantity").cast("bigint").alias("q"))
    return rows.groupBy("entity", "date").agg(
        F.min_by("u", "k").cast("double").alias("open"),
        F.max("u").cast("double").alias("high"),
        F.min("u").cast("double").alias("low"),
        F.max_by("u", "k").cast("double").alias("close"),
        F.sum("q").cast("double").alias("volume"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars two days later with their close as last_price: dates that often have no bar of their own."""
    return bars(spark, sf_dir).select(F.date_add("date", 2).alias("date"), "entity", F.col("close").alias("last_price"))


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_snapshots(snapshots(spark, sf_dir), bars(spark, sf_dir))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with a few features and the return 63 days ahead."""
    b = W.with_moves(bars(spark, sf_dir)).select("*", W.past_return(5).alias("ret_5d"), W.past_return(21).alias("ret_21d"), W.past_return(63).alias("ret_63d"), W.candles()["KMID"].alias("KMID"), W.volume_spike().alias("volume_spike_ratio"))
    prices = bars(spark, sf_dir).select("entity", "date", "close")
    return nearest_ahead(b, prices, 63, tolerance=7).where("matched IS NOT NULL").withColumn("fwd_ret", F.col("matched") / F.col("close") - 1).drop("matched", "matched_date")


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user and day; last_price is the day's value in cents."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.to_date("ts").alias("date"), F.round(F.col("value") * 100).cast("bigint").alias("c"))
    return e.groupBy("entity", "date").agg(F.sum("c").cast("double").alias("last_price"))
