"""Parsers of landed files: pipe-delimited lists, feeds, nested JSON. Fetching them is left to others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.functions.exprs import parse_timestamp, ratio
from sigframe.schema import TICKER, WORLD_TICKER


def short_volume(lines: DataFrame, line: str = "value", position: str | None = None) -> DataFrame:
    """entity, short_vol_ratio of Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|...; headers,
    short lines, words for numbers and empty totals drop out; of repeated symbols the last line counts."""
    p = F.split(F.col(line), r"\|")
    at = F.col(position) if position else F.monotonically_increasing_id()
    cols = lines.select(at.alias("_at"), F.size(p).alias("_n"), F.trim(F.get(p, 1)).alias("entity"), F.get(p, 2).try_cast("double").alias("short"), F.get(p, 4).try_cast("double").alias("total"))
    good = cols.where("_n >= 5 AND entity <> '' AND short IS NOT NULL AND total > 0")
    return good.groupBy("entity").agg(F.max_by(F.round(ratio(F.col("short"), F.col("total")), 4), "_at").alias("short_vol_ratio"))


def latest_within(df: DataFrame, as_of: Column, days: int = 5, date: str = "date") -> DataFrame:
    """The rows of the latest date from as_of back to `days` before."""
    near = df.where((F.col(date) <= as_of) & (F.col(date) >= F.date_sub(as_of, days)))
    latest = near.agg(F.max(date).alias("_latest"))
    return near.join(F.broadcast(latest), F.col(date) == F.col("_latest")).drop("_latest")


def symbol(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(raw)), "/", "-"), r"\$", "")


def symbol_directory(lines: DataFrame, line: str = "value") -> DataFrame:
    """entity, name from a pipe-delimited directory whose header names the columns; test issues, funds
    and the trailer drop out."""
    header = lines.where(F.col(line).contains("Security Name")).select(F.split(F.col(line), r"\|").alias("_h")).limit(1)

    def at(*names: str) -> Column:
        found = [F.nullif(F.array_position(F.transform("_h", F.trim), n), F.lit(0)) for n in names]
        return (F.coalesce(*found) if len(found) > 1 else found[0]).cast("int")

    rows = lines.where(~F.col(line).contains("Security Name") & ~F.col(line).startswith("File Creation Time")).crossJoin(F.broadcast(header))
    p = F.split(F.col(line), r"\|")
    pick = lambda *names: F.trim(F.try_element_at(p, at(*names)))
    cols = rows.select(symbol(pick("Symbol", "ACT Symbol")).alias("entity"), pick("Security Name").alias("name"), F.coalesce(pick("Test Issue"), F.lit("N")).alias("_test"), F.coalesce(pick("ETF"), F.lit("N")).alias("_etf"))
    return cols.where(F.col("entity").rlike(TICKER) & (F.col("_test") != "Y") & (F.col("_etf") != "Y")).groupBy("entity").agg(F.max("name").alias("name"))


def symbol_list(lines: DataFrame, line: str = "value", pattern: str = WORLD_TICKER) -> DataFrame:
    """Symbols of a list file: comments cut off, upper-cased, validated, each once."""
    s = F.upper(F.trim(F.substring_index(F.col(line), "#", 1)))
    return lines.select(s.alias("entity")).where(F.col("entity").rlike(pattern)).distinct()


def feed_items(feeds: DataFrame, xml: str = "xml", keep: tuple = ()) -> DataFrame:
    """keep..., title, ts for each <item> of RSS documents; nothing for malformed ones."""
    items = F.expr(f"regexp_extract_all({xml}, '(?s)<item\\\\b.*?</item>', 0)")
    each = feeds.select(*keep, F.explode(items).alias("_item"))
    inner = lambda tag: F.nullif(F.trim(F.regexp_extract("_item", rf"(?s)<{tag}\b[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1)), F.lit(""))
    return each.select(*keep, inner("title").alias("title"), parse_timestamp(inner("pubDate")).alias("ts")).where("title IS NOT NULL")


def filings(submissions: DataFrame, body: str = "json", keep: tuple = ("entity",)) -> DataFrame:
    """keep..., form, filed from parallel arrays of recent submissions."""
    recent = F.from_json(F.col(body), "filings struct<recent: struct<form: array<string>, filingDate: array<string>>>")["filings"]["recent"]
    rows = submissions.select(*keep, F.explode(F.arrays_zip(recent["form"].alias("form"), recent["filingDate"].alias("filed"))).alias("x"))
    return rows.select(*keep, "x.form", F.col("x.filed").try_cast("date").alias("filed"))


def daily_views(pages: DataFrame, body: str = "json", keep: tuple = ("entity",)) -> DataFrame:
    items = F.from_json(F.col(body), "items array<struct<timestamp: string, views: double>>")["items"]
    rows = pages.select(*keep, F.explode(items).alias("x"))
    return rows.select(*keep, F.try_to_timestamp(F.substring("x.timestamp", 1, 8), F.lit("yyyyMMdd")).cast("date").alias("day"), F.col("x.views").alias("views"))


def screened(pages: DataFrame, body: str = "json") -> DataFrame:
    """entity: the valid symbols among the quotes of screener answers, each once; malformed answers have none."""
    results = F.from_json(F.col(body), "finance struct<result: array<struct<quotes: array<struct<symbol: string>>>>>")["finance"]["result"]
    quotes = F.get(results, 0)["quotes"]
    return pages.select(F.explode(quotes).alias("q")).select(F.col("q.symbol").alias("entity")).where(F.col("entity").rlike(TICKER)).distinct()


def trending(pages: DataFrame, body: str = "json") -> DataFrame:
    """entity: upper-cased symbols of trending lists, each once."""
    symbols = F.from_json(F.col(body), "symbols array<struct<symbol: string>>")["symbols"]
    return pages.select(F.explode(symbols).alias("s")).select(F.upper("s.symbol").alias("entity")).where("entity <> ''").distinct()


def messages(pages: DataFrame, body: str = "json", keep: tuple = ("entity",)) -> DataFrame:
    """keep..., body, ts of the messages that have a text."""
    found = F.from_json(F.col(body), "messages array<struct<body: string, created_at: string>>")["messages"]
    rows = pages.select(*keep, F.explode(found).alias("m")).where("m.body <> ''")
    return rows.select(*keep, F.col("m.body").alias("body"), parse_timestamp(F.col("m.created_at")).alias("ts"))


def layered(*candidates: DataFrame) -> DataFrame:
    """The first candidate that has rows, else the last one: a universe with fallbacks."""
    for df in candidates[:-1]:
        if not df.isEmpty():
            return df
    return candidates[-1]


def neutral(universe: DataFrame, found: DataFrame, defaults: dict) -> DataFrame:
    """universe (entity) with found's features; what a source has not, or failed to give, is its neutral value."""
    out = universe.select("entity").distinct().join(found, "entity", "left")
    return out.select("entity", *[(F.col(k) if v is None else F.coalesce(F.col(k), F.lit(v))).alias(k) for k, v in defaults.items()])


def resolved(cache: DataFrame, found: DataFrame) -> DataFrame:
    """entity, article, by_name, resolved_at: per entity a hit by name beats one by symbol, then the later."""
    best = F.max_by(F.struct("article", "by_name", "resolved_at"), F.struct(F.col("article").isNotNull(), F.col("by_name"), F.col("resolved_at")))
    return cache.unionByName(found).groupBy("entity").agg(best.alias("x")).select("entity", "x.*")


def credible(*candidates: DataFrame, least: int = 100) -> DataFrame:
    """The first candidate with at least `least` rows, else the last one."""
    for df in candidates[:-1]:
        if df.limit(least).count() >= least:
            return df
    return candidates[-1]
