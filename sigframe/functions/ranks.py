"""Ranks inside groups, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigframe.session import kept


def avg_rank(by: list[str], x: str) -> Column:
    """1-based rank, ties averaged. Filter nulls of x first."""
    ties = F.count("*").over(Window.partitionBy(*by, x))
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (ties - 1) / 2.0


def pct_rank_or_half(by: list[str], x: str) -> Column:
    """Share of known values that are at most this one; 0.5 for null."""
    known = F.col(x).isNotNull()
    rank = F.cume_dist().over(Window.partitionBy(*by, known).orderBy(x))
    return F.when(known, rank).otherwise(0.5)


def rank01(by: list[str], x: str) -> Column:
    """Average rank scaled to [0, 1]."""
    n = F.count("*").over(Window.partitionBy(*by))
    return (avg_rank(by, x) - 1) / F.greatest(n - 1, F.lit(1))


def upper_median(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """by..., n, median: the element at n div 2 of the sorted values (the upper of two middle ones)."""
    known = rows.where(F.col(x).isNotNull())
    k = F.row_number().over(Window.partitionBy(*by).orderBy(x))
    n = F.count("*").over(Window.partitionBy(*by))
    middle = F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2) + 1, F.col(x)))
    return known.withColumn("_k", k).withColumn("_n", n).groupBy(*by).agg(F.count("*").alias("n"), middle.alias("median"))


def running(rows: DataFrame, by: list[str], order: list[str], amount: str = "_one") -> DataFrame:
    """rows with _before (the sum of `amount` over the rows before in the group's order) and _total.

    Groups may be whole tables: rows are dealt out by range and written, the parts' sums are added up
    (a row per part and group), and only a part is sorted by a task. `_one` counts rows. Ties in `order` are
    cut anywhere, so it should tell rows apart.
    """
    counted = rows.withColumn("_one", F.lit(1).cast("long")) if amount == "_one" else rows
    dealt = kept(counted.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "running")
    sums = dealt.groupBy(*by, "_part").agg(F.sum(amount).alias("_sum"))
    each = Window.partitionBy(*(by or [F.lit(0)]))
    offsets = kept(sums.withColumn("_below", F.sum("_sum").over(each.orderBy("_part")) - F.col("_sum")).withColumn("_total", F.sum("_sum").over(each)).drop("_sum"), "running")
    inside = F.sum(amount).over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(amount)
    placed = dealt.withColumn("_inside", inside).join(offsets, [*by, "_part"])
    return placed.withColumn("_before", F.col("_below") + F.col("_inside")).drop("_part", "_inside", "_below", "_one")


def ranked01(rows: DataFrame, by: list[str], x: str, out: str) -> DataFrame:
    """rows with `out`, which equals rank01; groups may be whole tables, as positions come from counts per value.

    x must be known in all rows.
    """
    values = running(rows.groupBy(*by, x).agg(F.count("*").alias("_n")), by, [x], "_n")
    places = values.select(*by, x, ((F.col("_before") + (F.col("_n") - 1) / 2.0) / F.greatest(F.col("_total") - 1, F.lit(1))).alias(out))
    return rows.join(places, [*by, x])
