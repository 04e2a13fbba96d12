"""Leaderboards over many signals and decay over many horizons, each in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.operators import metrics as M
from sigframe.operators.temporal import nearest_ahead
from sigframe.schema import DECAY_HORIZONS, DECAY_TOP, MIN_NAMES_PER_DATE
from sigframe.session import kept


def long_signals(labeled: DataFrame, signals: list[str], keep: list[str]) -> DataFrame:
    """One row per (row, signal): keep..., signal, value."""
    return labeled.unpivot(keep, signals, "signal", "value").withColumn("value", F.col("value").cast("double"))


def crowded_dates(labeled: DataFrame, least: int = MIN_NAMES_PER_DATE) -> DataFrame:
    """Rows of dates with at least `least` rows."""
    return labeled.withColumn("_n", F.count("*").over(Window.partitionBy("date"))).where(F.col("_n") >= least).drop("_n")


def leaderboard(labeled: DataFrame, signals: list[str], y: str = "fwd_ret", base: str | None = None) -> DataFrame:
    """A row per signal: mean rank correlation and its summary, neutralised correlation, decile spread,
    hit rate and turnover; greatest absolute correlation first.

    base: the column against which signals are neutralised, if any. The panel is written once; all
    statistics start from it.
    """
    keep = ["date", "entity", y, *([f"{base}__base"] if base else [])]
    rows = crowded_dates(labeled)
    if base:
        rows = rows.withColumn(f"{base}__base", F.col(base))
    long = long_signals(kept(rows.select(*dict.fromkeys([*keep, *signals])), "board"), signals, keep)
    by = ["signal", "date"]
    out = M.ic_summary(M.spearman(long, by, "value", y), ["signal"])
    placed = M.placed(M.known(long, "value", y), ["signal"], "value", ["date", "entity"], globally=True)
    spread = M.spread_of(placed, ["signal"], y).select("signal", "spread")
    hits = M.hits_of(placed, ["signal"], y).select("signal", "hit_rate")
    moves = M.turnover(long, ["signal"], "value").select("signal", "turnover")
    out = out.join(spread, "signal", "left").join(hits, "signal", "left").join(moves, "signal", "left")
    if base:
        left = M.residuals(long, by, "value", f"{base}__base")
        neutral = M.ic_summary(M.spearman(left, by, "residual", y), ["signal"]).select("signal", F.col("mean_ic").alias("neutral_ic"))
        out = out.join(neutral, "signal", "left")
    return out.orderBy(F.abs("mean_ic").desc_nulls_last(), "signal")


def ic_decay(snapshots: DataFrame, prices: DataFrame, signals: list[str], horizons: tuple = DECAY_HORIZONS, tolerance: int = 7, top: int = DECAY_TOP) -> DataFrame:
    """signal, one mean correlation per horizon, best: the `top` signals of greatest absolute one.

    All horizons go through one nearest join: each snapshot row is repeated per horizon.
    """
    each = snapshots.withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
    labeled = nearest_ahead(each.where("last_price > 0"), prices, F.col("horizon_days"), tolerance=tolerance).where("matched IS NOT NULL")
    labeled = labeled.withColumn("fwd_ret", F.col("matched") / F.col("last_price") - 1)
    keep = ["date", "entity", "horizon_days", "fwd_ret"]
    long = long_signals(labeled, signals, keep)
    by = ["signal", "horizon_days", "date"]
    crowded = long.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where(F.col("_n") >= MIN_NAMES_PER_DATE)
    ics = M.spearman(crowded, by, "value", "fwd_ret").groupBy("signal", "horizon_days").agg(F.avg("ic").alias("ic"))
    wide = ics.groupBy("signal").pivot("horizon_days", list(horizons)).agg(F.first("ic"))
    names = [f"h{h}" for h in horizons]
    wide = wide.toDF("signal", *names)
    best = F.greatest(*[F.coalesce(F.abs(F.col(n)), F.lit(-1.0)) for n in names])
    return wide.withColumn("best", best).orderBy(F.col("best").desc(), "signal").limit(top)
