"""Known answers, properties and point-in-time safety of the panel engine."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigframe.functions import exprs as X
from sigframe.functions import ranks as R
from sigframe.operators import metrics as M
from sigframe.operators import evaluate, features, labels, metrics, model, quality, relational, temporal, text
from sigframe.schema import FACTORS, FEATURES
from sigframe.sources import files, parsers, store, warehouse


def day(n, start=dt.date(2026, 1, 1)):
    return start + dt.timedelta(days=n)


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def bars_of(spark, rows):
    return spark.createDataFrame([(e, d, float(o), float(h), float(lo), float(c), float(v)) for e, d, o, h, lo, c, v in rows], "entity string, date date, open double, high double, low double, close double, volume double")


def test_names():
    assert len(FACTORS) == 46 and len(FEATURES) == 72


def test_average_ranks(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 10.0), (1, 20.0)], "g int, x double")
    assert sorted(r[0] for r in df.select(R.avg_rank(["g"], "x")).collect()) == [1.5, 1.5, 3.0]


def test_percentile_rank_null_is_half(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, None), (1, 3.0)], "g int, x double")
    assert sorted(r[0] for r in df.select(R.pct_rank_or_half(["g"], "x")).collect()) == pytest.approx([1 / 3, 0.5, 2 / 3, 1.0])


def test_spearman_and_constant(spark):
    df = spark.createDataFrame([(g, float(k), float(k if g == 1 else -k if g == 2 else 5)) for g in (1, 2, 3) for k in range(6)], "g int, x double, y double")
    got = dict(values(metrics.spearman(df, ["g"], "x", "y"), "g", "ic"))
    assert got == {1: 1.0, 2: -1.0, 3: None}


def test_auc(spark):
    df = spark.createDataFrame([(1, s, y) for s, y in ((0.1, 0.0), (0.2, 0.0), (0.8, 1.0), (0.9, 1.0))] + [(2, 0.5, 1.0)], "g int, s double, y double")
    assert dict(values(metrics.auc(df, ["g"], "s", "y"), "g", "auc")) == {1: 1.0, 2: None}


def test_price_label_and_relative(spark):
    snaps = spark.createDataFrame([(day(0), "AAA", 99.0)], "date date, entity string, last_price double")
    prices = spark.createDataFrame([("AAA", day(0), 100.0), ("AAA", day(63), 130.0)], "entity string, date date, close double")
    assert labels.label_snapshots(snaps, prices, 63, 10).first()["fwd_ret"] == pytest.approx(0.30)
    many = spark.createDataFrame([(day(0), e, r) for e, r in (("a", 0.30), ("b", 0.10), ("c", 0.05))], "date date, entity string, fwd_ret double")
    assert dict(values(labels.relative_return(many), "entity", "rel_ret"))["a"] == pytest.approx(0.20)


def test_nearest_tie_goes_to_the_earlier(spark):
    left = spark.createDataFrame([("A", day(0))], "entity string, date date")
    right = spark.createDataFrame([("A", day(8), 1.0), ("A", day(12), 2.0), ("A", day(0), 9.0)], "entity string, date date, close double")
    assert temporal.nearest_ahead(left, right, 10, tolerance=3).first()["matched"] == 1.0
    assert temporal.nearest_ahead(left, right, 10, tolerance=1).first()["matched"] is None
    assert temporal.nearest_ahead(left, right.where("close > 5"), 1, tolerance=3).first()["matched"] is None


def test_asof_tolerance(spark):
    left = spark.createDataFrame([("A", day(4)), ("A", day(5)), ("B", day(4))], "entity string, date date")
    right = spark.createDataFrame([("A", day(0), 7.0)], "entity string, date date, close double")
    assert sorted(values(temporal.asof_backward(left, right), "entity", "date", "matched")) == [("A", day(4), 7.0), ("A", day(5), None), ("B", day(4), None)]


def test_self_label(spark):
    snaps = spark.createDataFrame([(day(0), "AAA", 100.0), (day(63), "AAA", 150.0), (day(0), "BBB", 5.0)], "date date, entity string, last_price double")
    assert values(labels.label_from_snapshots(snaps), "entity", "fwd_ret") == [("AAA", 0.5)]


def test_flat_and_rising_factors(spark):
    flat = bars_of(spark, [("F", day(k), 100, 100, 100, 100, 1e6) for k in range(80)])
    row = features.compute_features(flat).orderBy(F.col("date").desc()).first()
    assert row["KMID"] == 0 and row["ROC_20"] == 1 and row["MA_20"] == 1 and row["STD_20"] == 0 and row["VMA_20"] == 1 and row["RSV_20"] is None and row["CNTP_20"] == 0
    closes = np.linspace(100, 200, 80)
    rising = bars_of(spark, [("R", day(k), closes[max(0, k - 1)], closes[k], closes[max(0, k - 1)], closes[k], 1e6) for k in range(80)])
    row = features.compute_features(rising).orderBy(F.col("date").desc()).first()
    assert row["ROC_20"] < 1 and row["CNTP_20"] == 1 and row["SUMP_20"] == pytest.approx(1) and row["RSV_20"] > 0.9 and row["rsi_14"] is None


def test_features_see_no_later_rows(spark):
    rng = np.random.default_rng(3)
    c = 100 + rng.normal(size=120).cumsum()
    rows = [("A", day(k), c[k], c[k] + 1, c[k] - 1, c[k], 1000 + k) for k in range(120)]
    whole = features.compute_features(bars_of(spark, rows)).where(F.col("date") == day(80)).first()
    cut = features.compute_features(bars_of(spark, rows[:81])).where(F.col("date") == day(80)).first()
    assert whole == cut


def test_planted_edge_leaderboard(spark):
    rng = np.random.default_rng(0)
    rows = []
    for t in range(12):
        for e in range(40):
            y = rng.normal()
            rows.append((day(t), f"e{e}", float(y + rng.normal()), float(rng.normal()), float(y * 0.1)))
    df = spark.createDataFrame(rows, "date date, entity string, good double, noise double, fwd_ret double")
    got = {r["signal"]: r for r in evaluate.leaderboard(df, ["good", "noise"]).collect()}
    assert got["good"]["mean_ic"] > 0.3 and abs(got["noise"]["mean_ic"]) < 0.1 and got["good"]["t_stat"] > 2


def test_turnover(spark):
    stay = [("s", day(t), f"e{k}", float(k)) for t in range(3) for k in range(10)]
    flip = [("f", day(t), f"e{k}", float(k if t % 2 else -k)) for t in range(3) for k in range(10)]
    df = spark.createDataFrame(stay + flip, "signal string, date date, entity string, value double")
    assert dict(values(metrics.turnover(df, ["signal"], "value"), "signal", "turnover")) == {"s": 0.0, "f": 1.0}


def test_neutralised(spark):
    rng = np.random.default_rng(3)
    rows = []
    for t in range(10):
        for e in range(40):
            base, fresh = rng.normal(), rng.normal()
            rows.append((day(t), f"e{e}", float(base), float(base + 0.05 * rng.normal()), float(fresh), float(base + fresh)))
    df = spark.createDataFrame(rows, "date date, entity string, ret_21d double, shadow double, fresh double, fwd_ret double")
    got = {r["signal"]: r for r in evaluate.leaderboard(df, ["shadow", "fresh"], base="ret_21d").collect()}
    assert abs(got["shadow"]["neutral_ic"]) < 0.15 and got["fresh"]["neutral_ic"] > 0.3


def test_purge(spark):
    df = spark.createDataFrame([(day(k), 5) for k in range(10)], "date date, horizon_days int")
    assert sorted(d.day - 1 for (d,) in values(labels.purged(df, F.lit(day(12))), "date")) == list(range(7))
    assert sorted(d.day - 1 for (d,) in values(labels.purged(df, F.lit(day(12)), 2), "date")) == list(range(5))


def test_walk_forward_learns(spark):
    rng = np.random.default_rng(1)
    rows = []
    for t in range(15):
        for e in range(40):
            x = rng.normal()
            rows.append((day(t), f"e{e:02d}", float(x), float(rng.normal()), float(x + 0.5 * rng.normal()), 1))
    df = labels.top_quantile(spark.createDataFrame(rows, "date date, entity string, a double, b double, fwd_ret double, horizon_days int"))
    oos = model.walk_forward(df, ["a", "b"]).withColumn("g", F.lit(1)).cache()
    assert metrics.auc(oos, ["g"], "score", "label").first()["auc"] > 0.65
    iso = model.calibrate(oos)
    p = [r["p"] for r in model.calibrated(iso, oos).select("p", "score").orderBy("score").collect()]
    assert all(0 <= a <= b <= 1 for a, b in zip(p, p[1:], strict=False))


def test_trees_boost_as_often_as_the_reference(monkeypatch):
    asked = {}

    class Trees:
        def __init__(self, **options):
            asked.update(options)

        def fit(self, train):
            return self

    monkeypatch.setattr(model, "GBTClassifier", Trees)
    model.fit_trees(None)
    assert (asked["maxIter"], asked["maxDepth"], asked["stepSize"]) == (200, 3, 0.05)


def test_trees_boost_cells_not_rows(spark, monkeypatch):
    """Rows of equal bins and label reach the rounds as one of their weight; bins keep few values apart."""
    rng = np.random.default_rng(40)
    rows = [(float(rng.integers(3)), float(a), float(a + rng.normal() > 0)) for a in rng.normal(size=4000)]
    x = model.matrix(spark.createDataFrame(rows, "a double, b double, label double"), ["a", "b"], {"a": (0.0, 1.0), "b": (0.0, 1.0)})
    seen = {}
    fit = model.fit_trees

    def few_rounds(train):
        seen["rows"], seen["weight"] = train.agg(F.count("*"), F.sum("weight")).first()
        return fit(train, 3)

    monkeypatch.setattr(model, "fit_trees", few_rounds)
    trees = model.BinnedTrees(x, 2)
    assert seen["weight"] == 4000 and seen["rows"] <= 2 * 3 * model.BINS
    assert trees.edges[0] == [1.0, 2.0] and len(trees.edges[1]) == model.BINS - 1
    got = {(r["a"], r["b"]): r["p"] for r in model.scored(trees, x, "p").collect()}
    full = model.binned(x, trees.edges, "bins").drop("x").withColumnRenamed("bins", "x").withColumn("weight", F.lit(1.0))
    want = {(r["a"], r["b"]): r["p"] for r in model.scored(fit(full, 3), full, "p").collect()}
    assert all(abs(got[k] - p) < 1e-9 for k, p in want.items())


def test_ranks_by_counts_equal_ranks_by_windows(spark):
    from sigframe.functions.ranks import rank01, ranked01

    rng = np.random.default_rng(41)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in rng.integers(0, 9, (300, 2))] + [(99, 1.0)], "g int, v double")
    got = ranked01(df, ["g"], "v", "r").withColumn("w", rank01(["g"], "v")).select("r", "w").collect()
    assert len(got) == 301 and all(r["r"] == r["w"] for r in got)


def test_isotonic_pools(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 0.0), (3.0, 1.0)], "score double, label double")
    iso = model.calibrate(df)
    assert [r["p"] for r in model.calibrated(iso, df).orderBy("score").collect()] == [0.5, 0.5, 1.0]


def test_names_and_queries(spark):
    raw = ["Artius II Acquisition Inc. - Class A Ordinary Shares", "Agnico Eagle Mines Limited Common Stock", "American Eagle Outfitters, Inc.", None]
    df = spark.createDataFrame([(r,) for r in raw], "name string")
    assert [r[0] for r in df.select(X.clean_name(F.col("name"))).collect()] == ["Artius II Acquisition", "Agnico Eagle Mines", "American Eagle Outfitters", ""]
    assert df.select(X.search_queries(F.lit("AAPL"), F.lit("Apple Inc."))).first()[0] == ["Apple Inc.", "Apple", "AAPL"]


def test_name_join_drops_ambiguous(spark):
    left = spark.createDataFrame([("AAPL", "Apple Inc. - Common Stock"), ("TWIN", "Twin Corp")], "entity string, name string")
    right = spark.createDataFrame([("APPLE INC", 1), ("Twin Holdings", 2), ("The Twin Co", 3)], "other string, cik int")
    assert values(relational.join_by_name(left, right, "name", "other", "cik"), "entity", "cik") == [("AAPL", 1)]


def test_recency(spark):
    df = spark.createDataFrame([(None,), (0.0,), (2.0,), (8.0,), (-1.0,)], "age double")
    assert [r[0] for r in df.select(X.recency_weight(F.col("age"), 2.0, 7.0)).collect()] == [1.0, 1.0, 0.5, 0.0, 0.0]
    texts = spark.createDataFrame([("Thu, 23 Jul 2026 12:00:00 GMT",), ("2026-07-22T12:00:00Z",), ("1784635200",), ("soon",)], "t string")
    now = F.lit("2026-07-24 12:00:00").cast("timestamp")
    assert [r[0] for r in texts.select(X.age_days(X.parse_timestamp(F.col("t")), now)).collect()] == [1.0, 2.0, 3.0, None]


def test_short_volume_and_directory(spark):
    lines = "Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market\n20260101|AAA|60|0|100|N\n20260101|BBB|25|0|100|N\n20260101|CCC|x|0|100|N\n20260101|DDD|1|0|0|N".split("\n")
    df = spark.createDataFrame([(x, k) for k, x in enumerate(lines)], "value string, n int")
    assert dict(values(parsers.short_volume(df, position="n"), "entity", "short_vol_ratio")) == {"AAA": 0.6, "BBB": 0.25}
    listing = ["Symbol|Security Name|Market|Test Issue|ETF", "AAPL|Apple|Q|N|N", "ZZZ|Test|Q|Y|N", "SPY|Fund|Q|N|Y", "BRK/A|Berkshire|Q|N|N", "File Creation Time: x|||"]
    got = dict(values(parsers.symbol_directory(spark.createDataFrame([(x,) for x in listing], "value string")), "entity", "name"))
    assert got == {"AAPL": "Apple", "BRK-A": "Berkshire"}


def test_feed_and_json(spark):
    xml = "<rss><channel><item><title>Up &lt;1</title><pubDate>Thu, 23 Jul 2026 12:00:00 GMT</pubDate></item><item><title>No date</title></item></channel></rss>"
    got = parsers.feed_items(spark.createDataFrame([("A", xml), ("B", "broken")], "entity string, xml string"), keep=("entity",)).collect()
    assert [(r["entity"], r["title"], r["ts"] is None) for r in got] == [("A", "Up &lt;1", False), ("A", "No date", True)]
    body = '{"filings":{"recent":{"form":["4","8-K/A","10-Q"],"filingDate":["2026-07-20","2026-07-01","2026-01-01"]}}}'
    f = parsers.filings(spark.createDataFrame([("A", body)], "entity string, json string"))
    assert values(text.recent_filings(f, F.lit(dt.date(2026, 7, 24))), "entity", "form4", "form8k") == [("A", 1, 1)]


def test_mentions_and_sentiment(spark):
    posts = spark.createDataFrame([("GME GME to the moon, IT rocks",), ("buy $GME and AMC",)], "text string")
    vocab = spark.createDataFrame([("GME",), ("AMC",), ("IT",)], "entity string")
    assert dict(values(text.mentions(posts, vocab), "entity", "mentions")) == {"GME": 2.0, "AMC": 1.0}
    s = spark.createDataFrame([("great gains",), ("not great",), ("fraud losses",), (None,)], "text string")
    a, b, c, d = (r[0] for r in s.select(text.sentiment()).collect())
    assert a > 0 > b and c < 0 and d == 0


def test_mentions_beside_other_scripts(spark):
    """Word boundaries are those of the SQL, whatever letter, digit or mark stands beside a token."""
    import duckdb

    texts = ["\u00e9TO be", "\u65e5\u672cTHE\u56fd", "\u0301TO", "TO\u0301", "x\u0663TO", "TO\u0663", "TO_", "_TO", "TO.\u00e9", "TO.a", "TO-", "\u00aaTO", "TO\x00IN", "THAT.THE-OF", "AND.\u00e9 AND-AND-AND", "TO TO", None, ""]
    want = "SELECT entity, count(*)::DOUBLE FROM (SELECT unnest(list_distinct(regexp_extract_all(text, '\\b[A-Z][A-Z.\\-]{0,6}\\b'))) AS entity FROM (SELECT unnest(?) AS text)) GROUP BY 1"
    want = dict(duckdb.execute(want, [texts]).fetchall())
    vocab = spark.createDataFrame([(v,) for v in want], "entity string")
    got = text.mentions(spark.createDataFrame([(t,) for t in texts], "text string"), vocab)
    assert want["TO"] > 5 and dict(values(got, "entity", "mentions")) == want


def test_business_days(spark):
    have = spark.createDataFrame([(dt.date(2026, 7, 27),)], "date date")
    got = temporal.missing_business_days(have, F.lit(dt.date(2026, 7, 24)), F.lit(dt.date(2026, 7, 29)))
    assert sorted(d for (d,) in values(got, "date")) == [dt.date(2026, 7, d) for d in (24, 28, 29)]


def test_priority_cap_never_cuts_the_first(spark):
    first = spark.createDataFrame([(f"W{k:02d}",) for k in range(30)], "entity string")
    second = spark.createDataFrame([(f"S{k:03d}",) for k in range(500)], "entity string")
    assert relational.priority_cap(first, second, 100).count() == 100
    assert relational.priority_cap(first, second, 10).count() == 30


def gate_rows(spark, dead_day):
    rows = []
    for t in range(5):
        for e in range(40):
            alive = t != dead_day
            rows.append((day(t), f"e{e}", {"ret_21d": 0.1, "ROC_20": 1.0, "news_count": 3.0 if alive else 0.0, "st_msg_count": 1.0, "short_vol_ratio": 0.4, "wiki_views_7d": 2.0, "eps_rev_90d": 0.1} | ({"ret_21d": float("nan")} if dead_day == 40 else {})))
    return spark.createDataFrame(rows, "date date, entity string, features map<string,double>")


def test_quality_gate(spark):
    verdict, code, report = quality.gate_verdict(gate_rows(spark, 4))
    status = {r["family"]: r["status"] for r in report}
    assert (verdict, code) == ("OK", 0) and status["news"] == "COLLAPSED" and status["reddit"] == "EXPECTED-DOWN" and status["prices"] == "OK"
    assert quality.gate_verdict(gate_rows(spark, 40))[:2] == ("FAIL", 1)
    assert quality.gate_verdict(gate_rows(spark, 9).limit(0))[:2] == ("FAIL", 1)


def test_archive_upsert_and_warehouse(spark, tmp_path):
    base, out = f"file:{tmp_path}/archive", f"file:{tmp_path}/flat"
    snap = spark.createDataFrame([("AAA", 0.3, 10.0, {"ret_5d": 0.3, "odd": float("nan")}), ("BBB", -0.1, 20.0, {"ret_5d": -0.1})], "entity string, score double, last_price double, features map<string,double>")
    for _ in range(2):
        assert store.append_snapshot(spark, base, snap, "2026-07-24") == (2, 2)
    assert store.load_features(spark, base).count() == 2
    store.append_snapshot(spark, base, snap.withColumn("score", F.col("score") + 1), "2026-08-03")
    assert store.load_features(spark, base).count() == 4
    store.append_snapshot(spark, base, snap.withColumn("score", F.col("score") + 5), "2026-08-03")
    assert sorted(r["score"] for r in store.load_features(spark, base).collect()) == pytest.approx([-0.1, 0.3, 4.9, 5.3])
    panel = spark.createDataFrame([("AAA", {"2026-07-01": 5.0, "bad": 1.0, "2026-07-02": -1.0})], "entity string, closes map<string,double>")
    assert store.append_prices(spark, base, panel) == (1, 1)
    counts = {r["archive"]: (r["rows"], r["dates"], r["entities"]) for r in store.update_manifest(spark, base).collect()}
    assert counts == {"features": (4, 2, 2), "prices": (1, 1, 1)}
    assert warehouse.compact(spark, base, out)["parquet_bytes"] > 0
    assert warehouse.sql(spark, out, "SELECT entity, f_ret_5d FROM features WHERE month = '2026-07' ORDER BY entity") == [("AAA", 0.3), ("BBB", -0.1)]
    plan = warehouse.read_month(spark, f"{out}/features", "2026-08-01").select("entity")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert store.tracked(spark, base).count() == 2 and files.exists(spark, f"{base}/features/month=2026-08")


def test_legacy_rows_yield_to_partitions(spark, tmp_path):
    base = f"file:{tmp_path}/a"
    snap = spark.createDataFrame([("AAA", 1.0, 1.0, {"x": 1.0})], "entity string, score double, last_price double, features map<string,double>")
    store.append_snapshot(spark, base, snap, "2026-07-24")
    (tmp_path / "a" / "features.jsonl").write_text('{"date":"2026-07-24","entity":"AAA","score":9}\n{"date":"2026-07-23","entity":"AAA","score":8}\nbroken\n')
    assert sorted(r["score"] for r in store.load_features(spark, base).collect()) == [1.0, 8.0]
    store.migrate_legacy(spark, base)
    assert sorted((r["score"], r["schema_version"]) for r in store.load_features(spark, base).collect()) == [(1.0, 2), (8.0, 1)]


def test_stream_is_idempotent(spark, tmp_path):
    from sigframe.streaming import archive

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"schema_version":2,"date":"2026-07-01","entity":"AAA","close":5.0}\n{"schema_version":2,"date":"2026-07-01","entity":"AAA","close":5.0}\n')
    from sigframe.schema import PRICE

    for k in range(2):
        rows = spark.readStream.schema(PRICE).json(f"file:{tmp_path}/in")
        archive.stream_prices(rows, f"file:{tmp_path}/base", f"file:{tmp_path}/cp{k}").awaitTermination(60)
    assert store.load_prices(spark, f"file:{tmp_path}/base").count() == 1


def test_backfill_and_reports(spark, tmp_path):
    from sigframe.operators import backfill, reports

    rng = np.random.default_rng(4)
    rows = [(e, day(k), 10, 11, 9, 10 + rng.random(), 1000) for e in ("A", "B", "C") for k in range(60 if e != "C" else 5)]
    short = spark.createDataFrame([("A", 0.4)], "entity string, short_vol_ratio double")
    got = backfill.snapshot_asof(bars_of(spark, rows), day(40), spark.createDataFrame([("A",), ("C",)], "entity string"), short)
    (r,) = got.collect()
    whole = features.compute_features(bars_of(spark, rows)).where((F.col("date") == day(40)) & (F.col("entity") == "A")).first()
    assert r["entity"] == "A" and r["backfilled"] and r["features"]["short_vol_ratio"] == 0.4 and r["features"]["ROC_20"] == whole["ROC_20"] and "news_count" in r["backfilled_missing"]
    base = f"file:{tmp_path}/a"
    store.append_snapshot(spark, base, got)
    assert store.has_snapshot(spark, base, day(40)) and not store.has_snapshot(spark, base, day(41))
    state = reports.status(store.update_manifest(spark, base), day(41))
    assert state["archives"]["features"]["rows"] == 1 and state["late"] and state["first_label"] == day(103)
    assert "| A |" in reports.to_markdown(store.load_features(spark, base).select("entity"), "T")


def test_fetch_keys(spark):
    from sigframe.sources import fetch

    def get(key):
        if key == "bad":
            raise OSError
        return key.upper()

    keys = spark.createDataFrame([("a",), ("a",), ("bad",)], "key string")
    assert dict(values(fetch.fetch_keys(keys, get, rate=1000, retries=1, pause=0.01, default="none"), "key", "body")) == {"a": "A", "bad": "none"}


def test_merge_later_source_wins(spark):
    u = spark.createDataFrame([("A",), ("B",)], "entity string")
    s1 = spark.createDataFrame([("A", {"x": 1.0, "y": 2.0}), ("Z", {"x": 9.0})], "entity string, features map<string,double>")
    s2 = spark.createDataFrame([("A", {"y": 3.0})], "entity string, features map<string,double>")
    assert dict(values(relational.merge_sources(u, [s1, s2]), "entity", "features")) == {"A": {"x": 1.0, "y": 3.0}, "B": {}}


def test_readiness(spark):
    few = spark.createDataFrame([(day(0), "a")], "date date, entity string")
    assert model.readiness(few)[0] is False


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=3, max_size=30))
def test_rank_sum_and_monotone_invariance(spark, xs):
    df = spark.createDataFrame([(1, float(x), float(k)) for k, x in enumerate(xs)], "g int, x double, y double")
    n = len(xs)
    assert sum(r[0] for r in df.select(R.avg_rank(["g"], "x")).collect()) == n * (n + 1) / 2
    a = metrics.spearman(df, ["g"], "x", "y").first()["ic"]
    b = metrics.spearman(df.withColumn("x", F.exp(F.col("x") / 20)), ["g"], "x", "y").first()["ic"]
    assert a == b


def prices(spark, rows):
    return spark.createDataFrame([(2, dt.date.fromisoformat(d), e, c) for d, e, c in rows], "schema_version int, date date, entity string, close double")


@pytest.mark.parametrize("fails", [1, 2, 3, 4])
def test_a_failed_swap_loses_no_row(spark, tmp_path, monkeypatch, fails):
    """Each rename of a write over two months fails in turn."""
    from sigframe.schema import PRICE

    path = f"file:{tmp_path}/base/prices"
    store.upsert(spark, path, prices(spark, [("2026-07-01", "A", 1.0), ("2026-07-02", "B", 2.0), ("2026-08-01", "A", 3.0), ("2026-08-02", "B", 4.0)]), PRICE)
    count, real = [0], files.rename

    def rename(spark, old, new):
        count[0] += 1
        if count[0] == fails:
            raise OSError("disk")
        real(spark, old, new)

    monkeypatch.setattr(files, "rename", rename)
    later = prices(spark, [("2026-07-01", "A", 10.0), ("2026-08-01", "A", 30.0)])
    with pytest.raises(OSError):
        store.upsert(spark, path, later, PRICE)
    got = {(str(r["date"]), r["entity"]): r["close"] for r in store.read_rows(spark, path, PRICE).collect()}
    assert len(got) == 4 and got["2026-07-02", "B"] == 2.0 and got["2026-08-02", "B"] == 4.0 and got["2026-08-01", "A"] == 3.0
    monkeypatch.setattr(files, "rename", real)
    store.upsert(spark, path, later, PRICE)
    assert sorted(r["close"] for r in store.read_rows(spark, path, PRICE).collect()) == [2.0, 4.0, 10.0, 30.0]


def test_a_dead_writer_is_made_good(spark, tmp_path):
    from sigframe.schema import PRICE

    path = f"file:{tmp_path}/base/prices"
    store.upsert(spark, path, prices(spark, [("2026-07-01", "A", 1.0), ("2026-08-01", "A", 3.0)]), PRICE)
    files.make(spark, f"{path}.stage-dead")
    files.rename(spark, f"{path}/month=2026-07", f"{path}.stage-dead/old-2026-07")
    store.upsert(spark, path, prices(spark, [("2026-08-01", "A", 4.0)]), PRICE)
    assert sorted(r["close"] for r in store.read_rows(spark, path, PRICE).collect()) == [1.0, 4.0]


def test_the_last_record_of_a_batch_wins(spark, tmp_path):
    from sigframe.schema import PRICE

    path = f"file:{tmp_path}/prices"
    assert store.upsert(spark, path, prices(spark, [("2026-07-01", "A", 9.0), ("2026-07-01", "B", 1.0), ("2026-07-01", "A", 10.0)]), PRICE) == (3, 2)
    store.upsert(spark, path, prices(spark, [("2026-07-01", "B", 8.0), ("2026-07-01", "B", 7.0)]), PRICE)
    assert sorted((r["entity"], r["close"]) for r in store.read_rows(spark, path, PRICE).collect()) == [("A", 10.0), ("B", 7.0)]
    ordered = prices(spark, [("2026-07-01", "A", 5.0), ("2026-07-01", "A", 6.0)]).withColumn("at", -F.col("close"))
    store.upsert(spark, path, ordered, PRICE, order="at")
    assert sorted(r["close"] for r in store.read_rows(spark, path, PRICE).collect()) == [5.0, 7.0]


def test_only_finite_pairs_count(spark):
    rows = [("d", float(k), float(k * k)) for k in range(6)] + [("d", float("nan"), 1.0), ("d", 2.0, float("inf")), ("d", None, 3.0), ("d", 5.0, float("nan"))]
    df = spark.createDataFrame(rows, "date string, x double, y double")
    assert M.spearman(df, ["date"], "x", "y").collect() == [("d", 6, 1.0)]


@pytest.mark.parametrize("parts", ["1", "7"])
def test_running_sums_over_ranges(spark, parts):
    from sigframe.functions.ranks import running

    rng = np.random.default_rng(50)
    rows = [("ab"[k % 2], int(rng.integers(40)), k, int(rng.integers(9))) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, k int, w long")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for amount in ("_one", "w"):
            got = {r["k"]: (r["_before"], r["_total"]) for r in running(df, ["g"], ["x", "k"], amount).collect()}
            for g, x, k, _ in rows:
                own = [(b, c, d if amount == "w" else 1) for a, b, c, d in rows if a == g]
                assert got[k] == (sum(d for b, c, d in own if (b, c) < (x, k)), sum(d for _, _, d in own))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert M.quantiles(df, "x", [0.2, 0.5, 1.0]) == pytest.approx(np.quantile([r[1] for r in rows], [0.2, 0.5, 1.0]).tolist())
    assert running(df.limit(0), ["g"], ["x"]).count() == 0


def test_learning_from_nothing_gives_no_rows(spark):
    from sigframe.operators import model

    df = spark.createDataFrame([("2026-01-01", "A", 1.0, 0.1, 1.0, 5)], "date string, entity string, a double, fwd_ret double, label double, horizon_days int").withColumn("date", F.col("date").cast("date"))
    for rows in (df, df.limit(0)):
        oos = model.walk_forward(rows, ["a"])
        assert oos.count() == 0 and {"fold", "score"} <= set(oos.columns)
        assert model.evaluate_calibration(oos).count() == 0 and M.auc(oos, ["fold"], "score", "label").count() == 0


def test_prediction_of_two_targets(spark):
    from sigframe.operators import model

    rng = np.random.default_rng(51)
    rows = []
    for k in range(12):
        for e in range(40):
            a = float(rng.normal())
            rows.append((dt.date(2026, 1, 1) + dt.timedelta(days=10 * k), f"E{e}", a, 0.4 * a + 0.05 * float(rng.normal()), float(a > 0.8), 5))
    df = spark.createDataFrame(rows, "date date, entity string, a double, fwd_ret double, label double, horizon_days int")
    got = model.predict(df, df.select("date", "entity", "a"), ["a"], top=5).collect()
    last = sorted((r[2], r[1]) for r in rows if r[0] == max(x[0] for x in rows))
    assert len(got) == 5 and {r["entity"] for r in got} <= {e for _, e in last[-12:]} and all(0 <= r["p_big"] <= 1 for r in got)
    assert model.predict(df, df.select("date", "entity", "a"), ["a"], top=40).where("p_big IS NULL").count() == 0
    small = model.predict(df.withColumn("fwd_ret", F.lit(0.0)), df.select("date", "entity", "a"), ["a"], top=3).collect()
    assert all(r["p_big"] is None for r in small)
