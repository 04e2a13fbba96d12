"""Rebuilding the snapshot of a missed date from what was known then."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.operators.features import compute_features
from sigframe.schema import BASE_FEATURES, FACTORS

#: What prices and the day's short-volume file give back; the rest of a snapshot is lost.
REBUILT = ("ret_5d", "ret_21d", "ret_63d", "rsi_14", "volume_spike_ratio", "pct_off_52w_high", "pct_above_52w_low", "annualized_vol", "short_vol_ratio", *FACTORS)


def snapshot_asof(bars: DataFrame, date, universe: DataFrame, short: DataFrame | None = None, min_history: int = 21) -> DataFrame:
    """Rows for `store.append_snapshot`: each entity's features at its last bar up to the date, flagged
    as backfilled, with the names of the features that are missing and no score."""
    day = F.lit(date).cast("date")
    known = compute_features(bars.where(F.col("date") <= day), min_history)
    back = F.row_number().over(Window.partitionBy("entity").orderBy(F.col("date").desc()))
    rows = known.withColumn("_k", back).where("_k = 1").join(universe.select("entity").distinct(), "entity", "left_semi")
    if short is not None:
        rows = rows.join(short.select("entity", "short_vol_ratio"), "entity", "left")
    else:
        rows = rows.withColumn("short_vol_ratio", F.lit(None).cast("double"))
    made = F.map_from_arrays(F.array(*[F.lit(k) for k in REBUILT]), F.array(*[F.col(k).cast("double") for k in REBUILT]))
    lost = F.array(*[F.lit(k) for k in BASE_FEATURES if k not in REBUILT])
    return rows.select(day.alias("date"), "entity", F.lit(None).cast("double").alias("score"), F.col("close").alias("last_price"), F.map_filter(made, lambda _, v: v.isNotNull()).alias("features"), F.lit(True).alias("backfilled"), lost.alias("backfilled_missing"))
