"""Trailing features per entity: returns, momentum, ranges, candles and rolling factors.

All windows are trailing and end at the row itself, so a feature at a date depends on no later row.
One partitioning by entity and one sort serve every window of a select.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigframe.functions.exprs import breadth, ratio, signed_change
from sigframe.schema import WINDOWS

def _by() -> Window:
    return Window.partitionBy("entity").orderBy("date")


def _last(w: int) -> Window:
    return _by().rowsBetween(-(w - 1), 0)


def _after(w: int, x: Column) -> Column:
    """Null until more than w rows are there."""
    return F.when(F.row_number().over(_by()) > w, x)


def past_return(n: int) -> Column:
    past = F.lag("close", n).over(_by())
    return F.when(past > 0, F.col("close") / past - 1)


def with_moves(bars: DataFrame) -> DataFrame:
    """bars with the close's step and relative step from the row before."""
    step = F.col("close") - F.lag("close").over(_by())
    return bars.withColumn("step", step).withColumn("ret", ratio(step, F.lag("close").over(_by())))


def rsi(period: int = 14) -> Column:
    """Of `step`: simple means of gains and losses; null without losses or history."""
    gain = F.avg(F.greatest("step", F.lit(0.0))).over(_last(period))
    loss = F.avg(F.greatest(-F.col("step"), F.lit(0.0))).over(_last(period))
    return _after(period, 100 - 100 / (1 + F.try_divide(gain, loss)))


def volume_spike() -> Column:
    recent = F.avg("volume").over(_last(5))
    base = F.when(F.row_number().over(_by()) > 65, F.avg("volume").over(_by().rowsBetween(-59, -5))).otherwise(F.avg("volume").over(_by().rowsBetween(Window.unboundedPreceding, 0)))
    return ratio(recent, base)


def off_high(n: int = 126) -> Column:
    return ratio(F.col("close"), F.max("close").over(_last(n))) - 1


def above_low(n: int = 126) -> Column:
    return ratio(F.col("close"), F.min("close").over(_last(n))) - 1


def annualized_vol(n: int = 126) -> Column:
    """Of `ret`: sample deviation of at least two steps, per year of 252."""
    return F.when(F.count("ret").over(_last(n)) >= 2, F.stddev_samp("ret").over(_last(n)) * F.sqrt(F.lit(252.0)))


def candles() -> dict[str, Column]:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    out = {
        "KMID": ratio(c - o, o),
        "KLEN": ratio(h - low, o),
        "KUP": ratio(h - F.greatest(o, c), o),
        "KLOW": ratio(F.least(o, c) - low, o),
        "KSFT": ratio(2 * c - h - low, o),
    }
    return {k: F.when(o > 0, v) for k, v in out.items()} | {"KMID2": F.when(h > low, ratio(c - o, h - low))}


def rolling_price(w: int) -> dict[str, Column]:
    c, last = F.col("close"), _last(w)
    high, low = F.max("high").over(last), F.min("low").over(last)
    made = {
        "ROC": ratio(F.lag("close", w).over(_by()), c),
        "MA": ratio(F.avg("close").over(last), c),
        "STD": ratio(F.stddev_pop("close").over(last), c),
        "MAX": ratio(high, c),
        "MIN": ratio(low, c),
        "RSV": ratio(c - low, high - low),
    }
    return {f"{k}_{w}": _after(w, v) for k, v in made.items()}


def rolling_corr(w: int) -> dict[str, Column]:
    last, v = _last(w), F.log1p("volume")
    spread = F.stddev_pop("close").over(last) * F.stddev_pop(v).over(last)
    return {f"CORR_{w}": _after(w, F.try_divide(F.covar_pop("close", v).over(last), spread))}


def rolling_strength(w: int) -> dict[str, Column]:
    last = _last(w)
    up = F.avg(F.when(F.col("step") > 0, 1.0).otherwise(0.0)).over(last)
    gains = F.sum(F.greatest("step", F.lit(0.0))).over(last)
    return {f"CNTP_{w}": _after(w, up), f"SUMP_{w}": _after(w, ratio(gains, F.sum(F.abs("step")).over(last)))}


def rolling_volume(w: int) -> dict[str, Column]:
    return {f"VMA_{w}": _after(w, F.when(F.col("volume") > 0, ratio(F.avg("volume").over(_last(w)), F.col("volume"))))}


def factor_columns() -> dict[str, Column]:
    """All 46 factors; of bars with `step`."""
    out = candles()
    for w in WINDOWS:
        out |= rolling_price(w) | rolling_corr(w) | rolling_strength(w) | rolling_volume(w)
    return out


def technical_columns(n: int = 126) -> dict[str, Column]:
    return {"ret_5d": past_return(5), "ret_21d": past_return(21), "ret_63d": past_return(63), "rsi_14": rsi(), "volume_spike_ratio": volume_spike(), "pct_off_52w_high": off_high(n), "pct_above_52w_low": above_low(n), "annualized_vol": annualized_vol(n)}


def compute_features(bars: DataFrame, min_history: int = 20) -> DataFrame:
    """(entity, date, close, features...) for entities with enough bars."""
    enough = F.count("close").over(Window.partitionBy("entity")) >= min_history
    rows = with_moves(bars.where("close IS NOT NULL")).withColumn("enough", enough).where("enough")
    return rows.select("entity", "date", "close", *[v.alias(k) for k, v in (technical_columns() | factor_columns()).items()])


def last_rows(bars: DataFrame, n: int) -> DataFrame:
    """The last n rows of each entity."""
    back = F.row_number().over(Window.partitionBy("entity").orderBy(F.col("date").desc()))
    return bars.withColumn("back", back).where(F.col("back") <= n).drop("back")


def estimate_features(estimates: DataFrame, returns: DataFrame) -> DataFrame:
    """Revision features of estimates (entity, current, ago_30, ago_90, up, down, analysts, target_mean, price)
    with each entity's own 63-day return (entity, ret_63d): what a revision is ahead of the price."""
    rows = estimates.join(returns.select("entity", "ret_63d"), "entity", "left")
    rev = lambda then: signed_change(F.col("current").cast("double"), F.col(then).cast("double"))
    target = F.when((F.col("target_mean") != 0) & (F.col("price") > 0), F.col("target_mean") / F.col("price") - 1)
    return rows.select(
        "entity",
        F.round(rev("ago_30"), 4).alias("eps_rev_30d"),
        F.round(rev("ago_90"), 4).alias("eps_rev_90d"),
        F.round(breadth(F.col("up"), F.col("down")), 4).alias("eps_rev_breadth"),
        F.round(rev("ago_90") - F.col("ret_63d"), 4).alias("eps_rev_vs_price"),
        F.col("analysts").cast("long").alias("analyst_count"),
        F.round(target, 4).alias("pt_upside"),
    )
