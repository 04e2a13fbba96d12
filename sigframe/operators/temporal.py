"""Temporal joins: backward as-of, nearest in a window ahead, row offsets, calendar gaps.

As-of and nearest joins put both sides in one time order per entity and carry values along, one
shuffle by entity and a sort, whatever the window's width; no pairs are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigframe.functions.exprs import is_business_day


def _in_order(left: DataFrame, right: DataFrame, at: Column, value: str, carried: list[str]) -> DataFrame:
    """Rows of both sides on one time line: entity, t, own (left's columns) and hit (right's)."""
    own = left.select("entity", at.alias("t"), F.struct(*carried).alias("own"), F.lit(None).cast(f"struct<date:date,value:{dict(right.dtypes)[value]}>").alias("hit"))
    hit = right.where(F.col(value).isNotNull()).select("entity", F.col("date").alias("t"), F.lit(None).cast(own.schema["own"].dataType).alias("own"), F.struct(F.col("date"), F.col(value).alias("value")).alias("hit"))
    return own.unionByName(hit)


def asof_backward(left: DataFrame, right: DataFrame, value: str = "close", tolerance: int = 4) -> DataFrame:
    """left (entity, date, ...) with `matched_date`, `matched`: the latest right row at or before date,
    if it is at most `tolerance` days old; null otherwise."""
    carried = left.columns
    w = Window.partitionBy("entity").orderBy("t", F.col("hit").isNull())
    rows = _in_order(left, right, F.col("date"), value, carried).withColumn("hit", F.last("hit", ignorenulls=True).over(w)).where("own IS NOT NULL")
    ok = F.datediff("t", F.col("hit.date")) <= tolerance
    return rows.select("own.*", F.when(ok, F.col("hit.date")).alias("matched_date"), F.when(ok, F.col("hit.value")).alias("matched"))


def nearest_ahead(left: DataFrame, right: DataFrame, horizon: Column | int, value: str = "close", tolerance: int = 7) -> DataFrame:
    """left with `matched_date`, `matched`: the right row after date that is nearest to date + horizon
    within the tolerance; of two equally near the earlier."""
    horizon = F.lit(horizon) if isinstance(horizon, int) else horizon
    carried = left.columns
    rows = _in_order(left, right, F.date_add("date", horizon.cast("int")), value, carried)
    back = F.last("hit", ignorenulls=True).over(Window.partitionBy("entity").orderBy("t", F.col("hit").isNull()))
    ahead = F.last("hit", ignorenulls=True).over(Window.partitionBy("entity").orderBy(F.col("t").desc(), F.col("hit").isNull()))
    rows = rows.withColumn("back", back).withColumn("ahead", ahead).where("own IS NOT NULL")
    early, late = F.datediff("t", "back.date"), F.datediff("ahead.date", "t")
    early = F.when((F.col("back.date") > F.col("own.date")) & (early <= tolerance), early)
    late = F.when((F.col("ahead.date") > F.col("own.date")) & (late <= tolerance), late)
    hit = F.when(early.isNotNull() & (late.isNull() | (early <= late)), F.col("back")).when(late.isNotNull(), F.col("ahead"))
    return rows.withColumn("hit", hit).select("own.*", F.col("hit.date").alias("matched_date"), F.col("hit.value").alias("matched"))


def row_offset_label(bars: DataFrame, horizon: int, step: int = 5, min_history: int = 63) -> DataFrame:
    """Every `step`-th bar after `min_history` with its return over the next `horizon` bars."""
    w = Window.partitionBy("entity").orderBy("date")
    rows = bars.withColumn("i", F.row_number().over(w) - 1).withColumn("ahead", F.lead("close", horizon).over(w))
    rows = rows.where((F.col("i") >= min_history) & ((F.col("i") - min_history) % step == 0) & F.col("ahead").isNotNull() & (F.col("close") > 0))
    return rows.withColumn("fwd_ret", F.col("ahead") / F.col("close") - 1).drop("ahead", "i")


def missing_business_days(have: DataFrame, start: Column, end: Column) -> DataFrame:
    """Weekdays from start to end without a row in `have` (date)."""
    bounds = have.agg(start.alias("a"), end.alias("b"))
    days = bounds.select(F.explode(F.sequence("a", "b")).alias("date")).where(is_business_day(F.col("date")))
    return days.join(have.select("date").distinct(), "date", "left_anti")


def universe_carry(gaps: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(date, entity): for each gap date the entities of the last snapshot before it, else of the latest."""
    dates = snapshots.select("date").distinct()
    both = gaps.select(F.col("date").alias("t"), F.lit(True).alias("gap")).union(dates.select(F.col("date").alias("t"), F.lit(False)))
    # one row per calendar date: bounded by the calendar, not by the data
    seen = F.max(F.when(~F.col("gap"), F.col("t"))).over(Window.partitionBy(F.lit(0)).orderBy("t").rangeBetween(Window.unboundedPreceding, -1))
    latest = F.max(F.when(~F.col("gap"), F.col("t"))).over(Window.partitionBy(F.lit(0)))
    days = both.withColumn("t", F.datediff("t", F.lit("1970-01-01").cast("date")))
    picked = days.withColumn("src", F.coalesce(seen, latest)).where("gap").select(F.date_add(F.lit("1970-01-01").cast("date"), F.col("t")).alias("date"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("src")).alias("src"))
    members = snapshots.select(F.col("date").alias("src"), "entity").distinct()
    return picked.join(members, "src").select("date", "entity")
