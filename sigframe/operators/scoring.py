"""Composite score: percentile ranks and shifted sentiments, weighted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.functions.exprs import ratio
from sigframe.functions.ranks import pct_rank_or_half
from sigframe.schema import SCORE_WEIGHTS


def _or_zero(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def mean_of_known(*names: str) -> Column:
    known = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    return ratio(sum((_or_zero(n) for n in names), F.lit(0.0)), known)


def composite_score(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows with a column per component and score (0 to 100), by date."""
    by = by or ["date"]
    raw = {
        "price_momentum": mean_of_known("ret_21d", "ret_63d"),
        "volume_spike": F.col("volume_spike_ratio"),
        "news_buzz": F.col("news_count"),
        "reddit_buzz": F.col("reddit_mentions"),
        "sec_activity": _or_zero("sec_form4_recent") + _or_zero("sec_8k_recent"),
        "st_attention": _or_zero("st_trending") * 100 + _or_zero("st_msg_count"),
        "wiki_attention": F.col("wiki_spike_ratio"),
        "short_pressure": F.col("short_vol_ratio"),
    }
    out = rows.withColumns({f"_{k}": v.cast("double") for k, v in raw.items()})
    out = out.withColumns({k: pct_rank_or_half(by, f"_{k}") for k in raw}).drop(*[f"_{k}" for k in raw])
    out = out.withColumns({k: (_or_zero(k) + 1) / 2 for k in ("news_sentiment", "reddit_sentiment")})
    total = sum((F.col(k) * w for k, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("score", total * 100)


def ranked(scored: DataFrame, n: int = 25) -> DataFrame:
    return scored.orderBy(F.col("score").desc(), "entity").limit(n)
