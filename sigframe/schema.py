"""Schemas, feature names and the constants that define semantics."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
HORIZON, TOLERANCE, BACK_TOLERANCE, STORE_TOLERANCE = 63, 7, 4, 10
MIN_NAMES_PER_DATE, TOP_FRACTION, DECILES, DECAY_TOP = 5, 0.2, 10, 12
COLLAPSE_RATIO, TRAILING_DATES, MIN_GATE_ROWS = 0.4, 5, 30
DECAY_HORIZONS = (21, 63, 126)
SCHEMA_VERSION = 2
WINDOWS = (5, 10, 20, 60)
KBAR = ("KMID", "KLEN", "KMID2", "KUP", "KLOW", "KSFT")
ROLLING = ("ROC", "MA", "STD", "MAX", "MIN", "RSV", "CORR", "CNTP", "SUMP", "VMA")
BASE_FEATURES = (
    "ret_5d", "ret_21d", "ret_63d", "volume_spike_ratio", "rsi_14", "pct_off_52w_high", "pct_above_52w_low",
    "annualized_vol", "news_count", "news_sentiment", "reddit_mentions", "reddit_sentiment", "sec_form4_recent",
    "sec_8k_recent", "st_trending", "st_msg_count", "st_sentiment", "wiki_views_7d", "wiki_spike_ratio",
    "short_vol_ratio", "eps_rev_30d", "eps_rev_90d", "eps_rev_breadth", "eps_rev_vs_price", "analyst_count", "pt_upside",
)
SCORE_WEIGHTS = {
    "price_momentum": 0.25, "volume_spike": 0.15, "news_buzz": 0.12, "news_sentiment": 0.08, "reddit_buzz": 0.12,
    "reddit_sentiment": 0.05, "sec_activity": 0.05, "st_attention": 0.08, "wiki_attention": 0.05, "short_pressure": 0.05,
}
#: family: (feature, what counts as alive, least share alive)
FAMILIES = {
    "prices": ("ret_21d", "notnull", 0.80),
    "factors": ("ROC_20", "notnull", 0.80),
    "news": ("news_count", "positive", 0.20),
    "stocktwits": ("st_msg_count", "positive", 0.20),
    "finra_short": ("short_vol_ratio", "notnull", 0.50),
    "wikipedia": ("wiki_views_7d", "positive", 0.10),
    "sec_filings": ("sec_form4_recent", "notnull", 0.10),
    "reddit": ("reddit_mentions", "positive", 0.01),
    "estimates": ("eps_rev_90d", "notnull", 0.15),
}
CATASTROPHIC, EXPECTED_DOWN = ("prices", "factors"), ("reddit", "sec_filings")
STOPWORDS = (
    "A", "I", "IT", "BE", "SO", "ON", "OR", "AT", "GO", "NO", "AM", "PM", "ALL", "ANY", "FOR", "ARE", "CEO", "CFO",
    "DD", "EPS", "IPO", "USA", "YOLO", "FD", "ATH", "EV", "AI", "US", "UK", "TV", "PR", "HODL",
)
TICKER = r"^[A-Z][A-Z.\-]{0,6}$"
WORLD_TICKER = r"^[A-Z0-9][A-Z0-9.\-]{0,14}$"
NAME_NOISE = r"(?i)\b(inc|corp|corporation|co|company|ltd|plc|holdings?|group|sa|nv|ag|limited|incorporated|lp|llc|trust|fund|the|new|class|common|stock|shares?|ordinary|depositary|american)\b"
LEGAL_SUFFIX = r"inc|corp|corporation|co|company|ltd|plc|holdings|group|sa|nv|ag|limited|incorporated|lp|llc|trust|fund"
SECURITY_QUALIFIER = r"(?:class|series)\s+[A-Z0-9]{1,2}|new|york|registry|american|depositary|depository|subordinate|voting|ordinary|common|preferred|capital|beneficial|redeemable|convertible|non|par|value|limited|partnership"
SECURITY_NOUN = r"stock|shares?|units?|rights?|warrants?|interests?"

FACTORS = (*KBAR, *(f"{f}_{w}" for f in ROLLING for w in WINDOWS))
FEATURES = (*BASE_FEATURES, *FACTORS)

SNAPSHOT = T.StructType([
    T.StructField("schema_version", T.IntegerType()), T.StructField("date", T.DateType()), T.StructField("entity", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("last_price", T.DoubleType()),
    T.StructField("components", T.MapType(T.StringType(), T.DoubleType())), T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("backfilled", T.BooleanType()), T.StructField("backfilled_missing", T.ArrayType(T.StringType())),
])
PRICE = T.StructType([
    T.StructField("schema_version", T.IntegerType()), T.StructField("date", T.DateType()), T.StructField("entity", T.StringType()), T.StructField("close", T.DoubleType()),
])
