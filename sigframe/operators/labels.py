"""Forward-return labels from price archives or snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigframe.operators.temporal import asof_backward, nearest_ahead
from sigframe.schema import BACK_TOLERANCE, HORIZON, STORE_TOLERANCE, TOLERANCE


def label_snapshots(snapshots: DataFrame, prices: DataFrame, horizon: int = HORIZON, tolerance: int = TOLERANCE, back: int = BACK_TOLERANCE) -> DataFrame:
    """snapshots (date, entity, last_price, ...) with entry_price, exit_price, fwd_ret, horizon_days.

    Entry: the archive's price as of the date, else the snapshot's own. Rows without an entry above 0
    or without an exit drop out.
    """
    entered = asof_backward(snapshots, prices, tolerance=back).withColumn("entry_price", F.coalesce("matched", "last_price")).drop("matched", "matched_date")
    left = nearest_ahead(entered.where("entry_price > 0"), prices, horizon, tolerance=tolerance).where("matched IS NOT NULL")
    return left.withColumnRenamed("matched", "exit_price").drop("matched_date").withColumn("fwd_ret", F.col("exit_price") / F.col("entry_price") - 1).withColumn("horizon_days", F.lit(horizon))


def label_from_snapshots(snapshots: DataFrame, horizon: int = HORIZON, tolerance: int = STORE_TOLERANCE) -> DataFrame:
    """Labels from later snapshots' last_price."""
    rows = nearest_ahead(snapshots.where("last_price > 0"), snapshots, horizon, "last_price", tolerance).where("matched IS NOT NULL")
    return rows.withColumn("fwd_ret", F.col("matched") / F.col("last_price") - 1).drop("matched", "matched_date")


def relative_return(labeled: DataFrame, by: str = "date", x: str = "fwd_ret") -> DataFrame:
    """With rel_ret: the return less its date's upper median.

    The median is the row numbered n div 2 + 1, found by a window, so no list is gathered.
    """
    order = Window.partitionBy(by).orderBy(x)
    n = F.count(x).over(Window.partitionBy(by))
    numbered = labeled.withColumn("_k", F.row_number().over(order)).withColumn("_n", n)
    median = F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2) + 1, F.col(x))).over(Window.partitionBy(by))
    return numbered.withColumn("median", median).withColumn("rel_ret", F.col(x) - F.col("median")).drop("_k", "_n")


def big_move(x: str = "fwd_ret", threshold: float = 0.30) -> Column:
    return (F.col(x) >= threshold).cast("double")


def top_quantile(labeled: DataFrame, x: str = "fwd_ret", top: float = 0.2, least: int = 5) -> DataFrame:
    """With label: 1.0 at or above the date's (1 - top) quantile (linear); 0.0 in dates with few rows."""
    w = Window.partitionBy("date")
    cut = F.percentile(x, F.lit(1 - top)).over(w)
    return labeled.withColumn("label", F.when((F.count("*").over(w) >= least) & (F.col(x) >= cut), 1.0).otherwise(0.0))


def purged(rows: DataFrame, test_start: Column, embargo: int = 0) -> DataFrame:
    """Training rows whose label ends before the test starts, less the embargo."""
    return rows.where(F.date_add("date", F.col("horizon_days").cast("int")) < F.date_sub(test_start, embargo))


def walk_forward_folds(rows: DataFrame, folds: int = 4) -> DataFrame:
    """With pos (0-based, by date then entity) and fold: 0 trains first, 1..folds are tested in turn,
    null for the remainder. Positions come from counts per date, so no task sorts all rows."""
    per_date = rows.groupBy("date").agg(F.count("*").alias("n"))
    # one row per calendar date
    starts = per_date.withColumn("start", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("date")) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    inside = F.row_number().over(Window.partitionBy("date").orderBy("entity")) - 1
    placed = rows.withColumn("_i", inside).join(starts.select("date", "start", "total"), "date")
    size = F.floor(F.col("total") / (folds + 1))
    fold = F.floor(F.try_divide(F.col("start") + F.col("_i"), size))  # null where there are fewer rows than folds
    return placed.withColumn("pos", F.col("start") + F.col("_i")).withColumn("fold", F.when(fold <= folds, fold).cast("int")).drop("_i", "start", "total")
