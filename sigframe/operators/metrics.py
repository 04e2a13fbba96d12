"""Cross-sectional statistics, each as DataFrame to DataFrame; groups are columns, never loops.

`by` holds the group columns, e.g. ["date"] or ["signal", "date"]; x is the signal, y the outcome.
Rows where either side is null, NaN or infinite drop out before any statistic. Statistics per signal over
all dates (`globally` True) take positions from sums over ranges, so that no task sorts a whole signal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigframe.functions.exprs import finite_or_null, moment_corr, ratio
from sigframe.functions.ranks import avg_rank, running
from sigframe.schema import DECILES, TOP_FRACTION


def known(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(finite_or_null(F.col(x)).isNotNull() & finite_or_null(F.col(y)).isNotNull())


def spearman(df: DataFrame, by: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """by..., n, ic: rank correlation per group, null where constant or fewer than `least` pairs."""
    ranked = known(df, x, y).withColumn("_rx", avg_rank(by, x)).withColumn("_ry", avg_rank(by, y))
    n = F.count("*").cast("double")
    corr = moment_corr(n, F.sum("_rx"), F.sum("_ry"), F.sum(F.col("_rx") * F.col("_rx")), F.sum(F.col("_ry") * F.col("_ry")), F.sum(F.col("_rx") * F.col("_ry")))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, corr).alias("ic"))


def ic_summary(ics: DataFrame, by: list[str], ic: str = "ic") -> DataFrame:
    """by..., n_dates, mean_ic, std_ic (0 for one), ir and t_stat (null without spread)."""
    mean, std, n = F.avg(ic), F.coalesce(F.stddev_samp(ic), F.lit(0.0)), F.count(ic)
    return ics.where(F.col(ic).isNotNull()).groupBy(*by).agg(n.alias("n_dates"), mean.alias("mean_ic"), std.alias("std_ic"), F.try_divide(mean, std).alias("ir"), (F.try_divide(mean, std) * F.sqrt(n)).alias("t_stat"))


def placed(df: DataFrame, by: list[str], x: str, ties: list[str], globally: bool = False) -> DataFrame:
    """df with _k (from 1, by x and then ties) and _n of its group."""
    if globally:
        out = running(df, by, [x, *ties])
        return out.withColumn("_k", F.col("_before") + 1).withColumnRenamed("_total", "_n").drop("_before")
    asc = Window.partitionBy(*by).orderBy(x, *ties)
    return df.withColumn("_k", F.row_number().over(asc)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))


def quantile_spread(df: DataFrame, by: list[str], x: str, y: str, q: int = DECILES, ties: tuple = ("date", "entity")) -> DataFrame:
    """by..., n, top, bottom, spread: mean outcome of the highest n div q less that of the lowest."""
    return spread_of(placed(known(df, x, y), by, x, list(ties)), by, y, q)


def spread_of(rows: DataFrame, by: list[str], y: str, q: int = DECILES) -> DataFrame:
    """`quantile_spread` of rows that are placed."""
    rows = rows.withColumn("_m", F.greatest(F.lit(1), F.floor(F.col("_n") / q)))
    top, bottom = F.avg(F.when(F.col("_k") > F.col("_n") - F.col("_m"), F.col(y))), F.avg(F.when(F.col("_k") <= F.col("_m"), F.col(y)))
    return rows.where(F.col("_n") >= 2 * q).groupBy(*by).agg(F.count("*").alias("n"), top.alias("top"), bottom.alias("bottom"), (top - bottom).alias("spread"))


def _top(n: Column, fraction: float) -> Column:
    return F.greatest(F.lit(1.0), F.rint(n * F.lit(fraction)))


def hit_rate(df: DataFrame, by: list[str], x: str, y: str, fraction: float = TOP_FRACTION, ties: tuple = ("date", "entity")) -> DataFrame:
    """by..., n, hit_rate: share of the top fraction with an outcome above 0."""
    return hits_of(placed(known(df, x, y), by, x, list(ties)), by, y, fraction)


def hits_of(rows: DataFrame, by: list[str], y: str, fraction: float = TOP_FRACTION) -> DataFrame:
    """`hit_rate` of rows that are placed."""
    best = F.col("_k") > F.col("_n") - _top(F.col("_n"), fraction)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.when(best, (F.col(y) > 0).cast("double"))).alias("hit_rate"))


def brier(df: DataFrame, by: list[str], p: str, y: str) -> DataFrame:
    return known(df, p, y).groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))


def auc(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by..., n_pos, n_neg, auc; null with one class.

    A row per value; each counts the negatives below its positives, and half of those beside them.
    """
    values = known(df, x, y).groupBy(*by, x).agg(F.count_if(F.col(y) > 0.5).alias("_pos"), F.count_if(F.col(y) <= 0.5).alias("_neg"))
    below = running(values, by, [x], "_neg")
    wins = F.sum(F.col("_pos") * (F.col("_before") + F.col("_neg") / 2.0))
    pos, neg = F.sum("_pos"), F.sum("_neg")
    return below.groupBy(*by).agg(pos.alias("n_pos"), neg.alias("n_neg"), ratio(wins, pos * neg).alias("auc"))


def quantiles(df: DataFrame, x: str, at: list[float]) -> list[float]:
    """Exact quantiles (linear) of a column without nulls, from the positions of its rows."""
    where = running(df.select(x), [], [x])
    total = df.count()
    spots = [q * (total - 1) for q in at]
    wanted = sorted({int(s) for s in spots} | {min(total - 1, int(s) + 1) for s in spots})
    found = {r["_before"]: r[x] for r in where.where(F.col("_before").isin(wanted)).collect()}  # two rows a quantile
    return [found[int(s)] + (s - int(s)) * (found[min(total - 1, int(s) + 1)] - found[int(s)]) for s in spots] if total else []


def calibration_table(df: DataFrame, p: str, y: str, bins: int = 5) -> DataFrame:
    """bucket, n, mean_p, mean_y over quantile buckets of p; empty buckets are left out."""
    rows = known(df, p, y)
    edges = quantiles(rows, p, [k / bins for k in range(1, bins)])
    bucket = sum(((F.col(p) >= F.lit(e)).cast("int") for e in edges), F.lit(0))
    return rows.groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def residuals(df: DataFrame, by: list[str], x: str, base: str, least: int = 3) -> DataFrame:
    """With residual: x less its slope on base times base (not centred); the slope is 0 where base is constant."""
    both = F.col(x).isNotNull() & F.col(base).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(base))
    w = Window.partitionBy(*by)
    slope = F.coalesce(F.try_divide(F.covar_pop(a, b).over(w), F.var_pop(b).over(w)), F.lit(0.0))
    return df.withColumn("residual", F.when(F.count(a).over(w) >= least, a - slope * b))


def turnover(df: DataFrame, signal: list[str], x: str, fraction: float = TOP_FRACTION, least: int = 5) -> DataFrame:
    """signal..., n_pairs, turnover: mean share of the top fraction that wasn't in it at the date before.

    Only known signals are ranked; dates with fewer than `least` are passed over.
    """
    by = [*signal, "date"]
    rows = placed(df.where(F.col(x).isNotNull()), by, x, ["entity"]).where(F.col("_n") >= least)
    top = rows.where(F.col("_k") > F.col("_n") - _top(F.col("_n"), fraction)).select(*by, "entity")
    dates = top.select(*by).distinct()
    before = F.lag("date").over(Window.partitionBy(*signal).orderBy("date")) if signal else F.lag("date").over(Window.partitionBy(F.lit(0)).orderBy("date"))
    dates = dates.withColumn("before", before).where("before IS NOT NULL")
    now = top.join(dates, by)
    was = top.select(*signal, F.col("date").alias("before"), "entity").withColumn("kept", F.lit(1))
    per_date = now.join(was, [*signal, "before", "entity"], "left").groupBy(*by).agg((1 - F.count("kept") / F.count("*")).alias("share"))
    return per_date.groupBy(*signal).agg(F.count("*").alias("n_pairs"), F.avg("share").alias("turnover"))


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation (1 where that is 0); null becomes 0."""
    stats = df.agg(*[s for c in columns for s in (F.avg(c).alias(f"_m_{c}"), F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"_s_{c}"))])
    out = df.join(F.broadcast(stats))
    return out.select(*[c for c in df.columns if c not in columns], *[F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"), F.lit(0.0)).alias(c) for c in columns])
