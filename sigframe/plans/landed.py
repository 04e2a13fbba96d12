"""Queries over landed files: the archive, the warehouse and the parsers, held against SQL over the tables they were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.functions import exprs as X
from sigframe.operators import backfill
from sigframe.operators import features as W
from sigframe.operators import quality as Q
from sigframe.operators import relational as J
from sigframe.plans import inputs as I
from sigframe.plans.catalog import _BARS, _LABELED, _SIGNALS, query
from sigframe.schema import PRICE, SCHEMA_VERSION
from sigframe.session import table, workspace
from sigframe.sources import parsers, store, warehouse

_PRICES = f"{_BARS}, prices AS (SELECT date, 'S' || entity AS entity, close FROM bars)"


def _prices(spark: SparkSession, d: str) -> DataFrame:
    """Closes as rows of the price archive."""
    return I.bars(spark, d).select(F.lit(SCHEMA_VERSION).alias("schema_version"), "date", F.concat(F.lit("S"), "entity").alias("entity"), "close")


def _archived(spark: SparkSession, d: str) -> str:
    base = workspace(spark, "archive")
    store.upsert(spark, f"{base}/prices", _prices(spark, d), PRICE)
    return base


@query("q_jsonl_scan", f"WITH {_PRICES} SELECT date, entity, close, strftime(date, '%Y-%m') AS month FROM prices")
def _(spark, d):
    """Rows of month files among which some lines are broken or have no key."""
    base = _archived(spark, d)
    lines = spark.createDataFrame([('{"date": "1995-02-03", "entity": "X", ',), ("",), ('{"entity": "X", "close": 1.0}',), ('{"date": "1995-02-03", "entity": "", "close": 1.0}',), ("[]",)], "value string")
    lines.coalesce(1).write.mode("append").text(f"{base}/prices/month=1995-02")
    return store.load_prices(spark, base).select("date", "entity", "close", "month")


@query("q_partition_scan", f"WITH {_PRICES} SELECT date, entity, close FROM prices WHERE strftime(date, '%Y-%m') IN ('1995-03', '1996-11')")
def _(spark, d):
    return store.read_rows(spark, f"{_archived(spark, d)}/prices", PRICE, ["1995-03", "1996-11", "1890-01"]).select("date", "entity", "close")


@query("q_upsert", f"WITH {_PRICES} SELECT date, entity, CASE WHEN date >= DATE '1998-01-01' THEN close + 2 ELSE close END AS close FROM prices")
def _(spark, d):
    """Written, and written again from 1998 on with two rows per key, of which the last counts."""
    base, rows = _archived(spark, d), _prices(spark, d)
    late = rows.where("date >= '1998-01-01'")
    twice = late.withColumn("close", F.explode(F.array(F.col("close") + 10, F.col("close") + 2)))
    for _ in range(2):
        store.upsert(spark, f"{base}/prices", twice, PRICE)
    return store.load_prices(spark, base).select("date", "entity", "close")


@query("q_append_prices", f"WITH {_PRICES} SELECT entity, count(*) AS days, min(date) AS first_date, max(date) AS last_date FROM prices WHERE close > 0 GROUP BY entity")
def _(spark, d):
    """Panels in, panels out; bad dates and closes drop out."""
    base = workspace(spark, "archive")
    made = F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string"), "close")))
    panel = _prices(spark, d).groupBy("entity").agg(made.alias("closes")).withColumn("closes", F.map_concat("closes", F.create_map(F.lit("bad"), F.lit(1.0), F.lit("1990-01-01"), F.lit(-1.0))))
    store.append_prices(spark, base, panel)
    panels = store.price_panel(store.load_prices(spark, base))
    return panels.select("entity", F.size("closes").cast("long").alias("days"), F.get("closes", 0)["date"].alias("first_date"), F.element_at("closes", -1)["date"].alias("last_date"))


_SNAPPED = f"{_PRICES}, snapped AS (SELECT date, entity, close AS score FROM prices WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-06-30')"


def _snapshots(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """An archive of snapshots whose first quarter lies in the legacy file, with some rows of April that yield to the partitions."""
    base = workspace(spark, "archive")
    rows = _prices(spark, d).where("date BETWEEN '1996-01-01' AND '1996-06-30'").select("date", "entity", F.col("close").alias("score"), F.col("close").alias("last_price"))
    rows = rows.withColumn("features", F.create_map(F.lit("ret_5d"), F.col("score") / 2, F.lit("odd"), F.lit(float("nan"))))
    store.append_snapshot(spark, base, rows.where("date >= '1996-04-01'"))
    old = rows.where("date < '1996-05-01'").withColumn("score", F.when(F.col("date") >= "1996-04-01", -1.0).otherwise(F.col("score")))
    old.select("date", "entity", "score", "last_price").write.json(f"{base}/features.jsonl")
    return base, rows


@query("q_legacy_rows", f"WITH {_SNAPPED} SELECT date, entity, score, CASE WHEN date < DATE '1996-04-01' THEN 1 ELSE 2 END AS schema_version FROM snapped")
def _(spark, d):
    base, _ = _snapshots(spark, d)
    return store.load_features(spark, base).select("date", "entity", "score", "schema_version")


@query("q_migrated", f"""WITH {_SNAPPED} SELECT 'features' AS archive, count(*) AS "rows", count(DISTINCT date) AS dates, min(date) AS first_date, max(date) AS last_date, count(DISTINCT entity) AS entities FROM snapped""")
def _(spark, d):
    """The legacy file folded in by a later append; the manifest is read from its file."""
    base, rows = _snapshots(spark, d)
    store.append_snapshot(spark, base, rows.where("date >= '1996-06-01'"))
    return spark.read.json(f"{base}/manifest").where("archive = 'features'").select("archive", "rows", "dates", F.col("first_date").cast("date").alias("first_date"), F.col("last_date").cast("date").alias("last_date"), "entities")


@query("q_collected", f"WITH {_SNAPPED}, days AS (SELECT DISTINCT date FROM snapped) SELECT CAST(x.d AS DATE) AS date, x.d IN (SELECT date FROM days) AS there FROM (VALUES (DATE '1996-05-07'), (DATE '1996-06-12'), (DATE '1997-01-01')) x(d)")
def _(spark, d):
    base = workspace(spark, "archive")
    store.append_snapshot(spark, base, _prices(spark, d).where("date BETWEEN '1996-01-01' AND '1996-06-30'").select("date", "entity", F.col("close").alias("score")))
    days = ("1996-05-07", "1996-06-12", "1997-01-01")
    return spark.createDataFrame([(x, store.has_snapshot(spark, base, x)) for x in days], "date string, there boolean").select(F.col("date").cast("date").alias("date"), "there")


@query("q_warehouse", f"WITH {_SNAPPED} SELECT strftime(date, '%Y-%m') AS month, count(*) AS n, min(score / 2) AS least, count(*) AS plain FROM snapped WHERE date >= DATE '1996-04-01' GROUP BY 1")
def _(spark, d):
    """Compacted, with its views; a NaN feature comes out null."""
    base, out = _snapshots(spark, d)[0], workspace(spark, "flat")
    warehouse.compact(spark, base, out)
    return warehouse.frame(spark, out, "SELECT month, count(*) AS n, min(f_ret_5d) AS least, count_if(f_other['odd'] IS NULL) AS plain FROM features WHERE date >= DATE '1996-04-01' GROUP BY month")


@query("q_warehouse_months", f"WITH {_PRICES} SELECT date, entity, close FROM prices WHERE date BETWEEN DATE '1997-02-10' AND DATE '1997-04-03'")
def _(spark, d):
    base, out = _archived(spark, d), workspace(spark, "flat")
    warehouse.compact(spark, base, out)
    return warehouse.read_month(spark, f"{out}/prices", "1997-02-10", "1997-04-03").select("date", "entity", "close")


@query("q_warehouse_summary", f"WITH {_PRICES} SELECT 0 AS features_rows, count(*) AS prices_rows, true AS smaller FROM prices")
def _(spark, d):
    base, out = _archived(spark, d), workspace(spark, "flat")
    warehouse.compact(spark, base, out)
    return spark.read.json(f"{out}/summary").select("features_rows", "prices_rows", (F.col("parquet_bytes") < F.col("jsonl_bytes")).alias("smaller"))


@query("q_snapshot_asof", f"WITH {_SIGNALS}, k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY entity) AS n FROM feats WHERE date <= DATE '1998-03-02') SELECT DATE '1998-03-02' AS date, entity, close AS last_price, ret_5d, ret_63d, true AS backfilled FROM k WHERE k = 1 AND n >= 21 AND entity % 2 = 0")
def _(spark, d):
    universe = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("entity"))
    rows = backfill.snapshot_asof(I.bars(spark, d), "1998-03-02", universe)
    return rows.select("date", "entity", "last_price", F.col("features")["ret_5d"].alias("ret_5d"), F.col("features")["ret_63d"].alias("ret_63d"), "backfilled")


# Parsers: the files are lines made from the tables.


@query("q_short_volume", "SELECT upper('S' || p_partkey) AS entity, round(p_size / (p_size + p_retailprice), 4) AS short_vol_ratio FROM part")
def _(spark, d):
    rows = table(spark, d, "part").select(F.expr("concat_ws('|', '20240105', concat('S', p_partkey), p_size, 0, p_size + p_retailprice, 'Q')").alias("value"))
    bad = spark.createDataFrame([("Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market",), ("20240105|AAA|x|0|5|Q",), ("20240105|BBB|1|0|0|Q",), ("short|line",), ("",), (None,)], "value string")
    return parsers.short_volume(rows.union(bad))


@query("q_latest_within", "WITH e AS (SELECT event_id, CAST(ts AS DATE) AS date FROM events WHERE CAST(ts AS DATE) NOT BETWEEN DATE '2024-01-10' AND DATE '2024-01-12') SELECT event_id, date FROM e WHERE date = (SELECT max(date) FROM e WHERE date <= DATE '2024-01-12')")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.to_date("ts").alias("date")).where("date NOT BETWEEN '2024-01-10' AND '2024-01-12'")
    return parsers.latest_within(e, F.lit("2024-01-12").cast("date"))


@query("q_symbol_directory", "SELECT 'A' || translate(p_partkey::VARCHAR, '0123456789', 'ABCDEFGHIJ') AS entity, p_name AS name FROM part WHERE p_size % 5 NOT IN (0, 1) AND p_partkey < 1000000")
def _(spark, d):
    symbol = "concat('A', translate(CAST(p_partkey AS STRING), '0123456789', 'ABCDEFGHIJ'))"
    rows = table(spark, d, "part").where("p_partkey < 1000000").select(F.expr(f"concat_ws('|', {symbol}, p_name, if(p_size % 5 = 0, 'Y', 'N'), if(p_size % 5 = 1, 'Y', 'N'))").alias("value"))
    more = spark.createDataFrame([("Symbol|Security Name|Test Issue|ETF",), ("File Creation Time: 0105202421:30|||",), ("TOOLONGSYMBOL|x|N|N",), ("",)], "value string")
    return parsers.symbol_directory(more.union(rows))


@query("q_symbol_list", "SELECT DISTINCT upper('b' || s_suppkey) AS entity FROM supplier")
def _(spark, d):
    rows = table(spark, d, "supplier").select(F.explode(F.array(F.expr("concat(' b', s_suppkey, '  # a note')"), F.expr("concat('B', s_suppkey)"), F.lit("# all"), F.lit("not ok!"))).alias("value"))
    return parsers.symbol_list(rows)


@query("q_feed_items", "SELECT user_id, 'item ' || event_id AS title, date_trunc('second', ts) AS ts FROM events WHERE event_id % 7 <> 0")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    title = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.lit("<title><![CDATA[item "), "event_id", F.lit("]]></title>")))
    item = F.concat(F.lit("<item>"), title, F.lit("<pubDate>"), F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item>"))
    feeds = e.groupBy("user_id").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("xml"))
    return parsers.feed_items(feeds, keep=("user_id",)).select("user_id", "title", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("q_filings", "SELECT user_id AS entity, CASE WHEN event_type = 'click' THEN '4' ELSE event_type END AS form, CAST(ts AS DATE) AS filed FROM events")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.struct(F.when(F.col("event_type") == "click", "4").otherwise(F.col("event_type")).alias("form"), F.to_date("ts").cast("string").alias("filed")).alias("x"))
    body = F.to_json(F.struct(F.struct(F.struct(F.col("l.form").alias("form"), F.col("l.filed").alias("filingDate")).alias("recent")).alias("filings")))
    return parsers.filings(e.groupBy("entity").agg(F.collect_list("x").alias("l")).select("entity", body.alias("json")).union(spark.createDataFrame([(-1, "broken")], "entity long, json string")))


@query("q_daily_views", "SELECT user_id AS entity, CAST(ts AS DATE) AS day, count(*)::DOUBLE AS views FROM events GROUP BY 1, 2")
def _(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("day")).agg(F.count("*").alias("views"))
    items = F.collect_list(F.struct(F.concat(F.date_format("day", "yyyyMMdd"), F.lit("00")).alias("timestamp"), "views"))
    return parsers.daily_views(e.groupBy("entity").agg(F.to_json(F.struct(items.alias("items"))).alias("json")))


@query("q_screened", "SELECT DISTINCT 'Q' || translate(p_size::VARCHAR, '0123456789', 'ABCDEFGHIJ') AS entity FROM part")
def _(spark, d):
    quotes = table(spark, d, "part").groupBy("p_brand").agg(F.collect_list(F.struct(F.expr("concat('Q', translate(CAST(p_size AS STRING), '0123456789', 'ABCDEFGHIJ'))").alias("symbol"))).alias("quotes"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct("quotes")).alias("result")).alias("finance")))
    odd = spark.createDataFrame([("nonsense",), ('{"finance": {"result": []}}',), ('{"finance": {"result": [{"quotes": [{"symbol": "bad one"}, {}]}]}}',), (None,)], "json string")
    return parsers.screened(quotes.select(body.alias("json")).union(odd))


@query("q_trending", "SELECT DISTINCT upper(event_type) AS entity FROM events")
def _(spark, d):
    body = F.to_json(F.struct(F.collect_set(F.struct(F.col("event_type").alias("symbol"))).alias("symbols")))
    return parsers.trending(table(spark, d, "events").groupBy("user_id").agg(body.alias("json")).select("json").union(spark.createDataFrame([("[]",), ('{"symbols": [{}, {"symbol": ""}]}',)], "json string")))


@query("q_messages", "SELECT user_id AS entity, event_type AS body, date_trunc('second', ts) AS ts FROM events WHERE event_type <> 'view'")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", F.struct(F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("body"), F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("created_at")).alias("m"))
    pages = e.groupBy(F.col("user_id").alias("entity")).agg(F.to_json(F.struct(F.collect_list("m").alias("messages"))).alias("json"))
    return parsers.messages(pages).select("entity", "body", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("q_resolved", "SELECT p_size AS entity, arg_max(p_name, (p_brand, p_partkey)) AS article FROM part GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "part").select(F.col("p_size").alias("entity"), F.col("p_name").alias("article"), F.lit(True).alias("by_name"), F.concat("p_brand", F.format_string("%012d", "p_partkey")).alias("resolved_at"))
    symbol = rows.withColumns({"article": F.lit("by symbol"), "by_name": F.lit(False), "resolved_at": F.lit("zzz")})
    return parsers.resolved(rows.where("by_name"), symbol.unionByName(rows.withColumns({"article": F.lit(None).cast("string"), "resolved_at": F.lit("zzzz")}))).select("entity", "article")


@query("q_universe_layers", "SELECT s_suppkey AS entity FROM supplier")
def _(spark, d):
    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"))
    return parsers.layered(own.where("entity < 0"), parsers.credible(own.limit(3), own, least=5), own.limit(1))


# Estimates, neutral values, presence, quarters, the gold sink.


_ESTIMATES = """est AS (SELECT s_suppkey AS entity, s_acctbal AS current, s_acctbal - s_suppkey % 7 AS ago_30, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_acctbal - s_suppkey % 11 END AS ago_90, s_suppkey % 4 AS up, s_suppkey % 3 AS down, s_suppkey % 9 AS analysts,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_suppkey + 10.0::DOUBLE END AS target_mean, s_suppkey * 1.0::DOUBLE AS price FROM supplier),
  rets AS (SELECT entity, ret_63d FROM (SELECT entity, ret_63d, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS k FROM feats) WHERE k = 1)"""


@query("q_estimates", f"""WITH {_SIGNALS}, {_ESTIMATES} SELECT entity, round((current - ago_30) / nullif(abs(ago_30), 0), 4) AS eps_rev_30d, round((current - ago_90) / nullif(abs(ago_90), 0), 4) AS eps_rev_90d, CASE WHEN up + down > 0 THEN round((up - down) / (up + down)::DOUBLE, 4) END AS eps_rev_breadth,
  round((current - ago_90) / nullif(abs(ago_90), 0) - ret_63d, 4) AS eps_rev_vs_price, analysts AS analyst_count, round(target_mean / price - 1, 4) AS pt_upside FROM est LEFT JOIN rets USING (entity)""")  # fmt: skip
def _(spark, d):
    s = table(spark, d, "supplier")
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    rows = s.select(
        k.alias("entity"), bal.alias("current"), (bal - k % 7).alias("ago_30"), F.when(k % 5 == 0, 0.0).otherwise(bal - k % 11).alias("ago_90"), (k % 4).alias("up"), (k % 3).alias("down"),
        (k % 9).alias("analysts"), F.when(k % 6 != 0, k + 10.0).alias("target_mean"), (k * 1.0).cast("double").alias("price"),
    )
    moves = W.with_moves(I.bars(spark, d)).select("entity", "date", W.past_return(63).alias("ret_63d"))
    return W.estimate_features(rows, W.last_rows(moves, 1))


@query("q_neutral_source", "SELECT s_suppkey AS entity, coalesce(n, 0) AS st_msg_count, coalesce(m, 0.0)::DOUBLE AS st_sentiment, CASE WHEN n > 5 THEN 1 END AS seen FROM supplier LEFT JOIN (SELECT user_id, count(*) AS n, round(avg(value), 6) AS m FROM events WHERE event_type = 'error' GROUP BY 1) ON user_id = s_suppkey")
def _(spark, d):
    found = table(spark, d, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("entity")).agg(F.count("*").alias("st_msg_count"), F.round(F.avg("value"), 6).alias("st_sentiment"), F.when(F.count("*") > 5, 1).alias("seen"))
    return parsers.neutral(table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity")), found, {"st_msg_count": 0, "st_sentiment": 0.0, "seen": None})


_PRESENCE = {"returns": ("ret_5d", "notnull", 0.5), "quarter": ("ret_63d", "notnull", 0.5), "spike": ("volume_spike_ratio", "positive", 0.5)}


@query("q_family_presence", f"WITH {_SIGNALS} SELECT 'returns' AS family, count(ret_5d) AS present, count(*) AS n FROM feats UNION ALL SELECT 'quarter', count(ret_63d), count(*) FROM feats UNION ALL SELECT 'spike', count(*) FILTER (volume_spike_ratio > 0), count(*) FROM feats")
def _(spark, d):
    rows = W.with_moves(I.bars(spark, d)).select(W.past_return(5).alias("ret_5d"), W.past_return(63).alias("ret_63d"), W.volume_spike().alias("volume_spike_ratio"))
    return Q.family_presence(rows, _PRESENCE)


@query("q_quarters_back", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, t.i AS back, CAST(year(o_orderdate - to_months(CAST(3 * t.i AS INTEGER))) AS INTEGER) AS year, CAST(quarter(CAST(date_trunc('month', o_orderdate) AS DATE) - to_months(CAST(3 * t.i AS INTEGER))) AS INTEGER) AS quarter FROM orders, range(5) t(i)")
def _(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", F.posexplode(X.quarters_back(F.col("day"))).alias("back", "q")).select("day", F.col("back").cast("long").alias("back"), "q.year", "q.quarter")


@query("q_gold", f"WITH {_LABELED} SELECT count(*) AS examples, count(DISTINCT date) AS dates, count(DISTINCT entity) AS entities, round(avg((fwd_ret > 0)::INT), 4) AS positive_rate, round(avg(fwd_ret), 4) AS mean_ret, 0.0::DOUBLE AS missing_entry, count(*) AS written FROM labeled")
def _(spark, d):
    """The gold sink's files, read back."""
    out = workspace(spark, "gold")
    Q.write_gold(I.labeled(spark, d), ["entry_price"], out, 63)
    written = spark.read.json(f"{out}/labeled_63d").agg(F.count("fwd_ret").alias("written"))
    quality = spark.read.json(f"{out}/quality_63d")
    return quality.join(F.broadcast(written)).select("examples", "dates", "entities", "positive_rate", "mean_ret", F.col("missing.entry_price").alias("missing_entry"), "written")


@query("q_argument_lookup", "SELECT o_orderkey, c_acctbal FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def _(spark, d):
    """Values looked up by key for a source that takes them as arguments."""
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return J.lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey").select("o_orderkey", "c_acctbal")
