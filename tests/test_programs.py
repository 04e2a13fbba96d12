"""Whole runs over a small archive."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigframe import programs
from sigframe.__main__ import main
from sigframe.sources import files, store

FIRST = dt.date(2026, 1, 5)


@pytest.fixture(scope="module")
def bars(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    days = [FIRST + dt.timedelta(days=k) for k in range(300) if (FIRST + dt.timedelta(days=k)).weekday() < 5]
    rows = []
    for e in range(36):
        close = 50.0 * np.cumprod(1 + rng.normal(0.001 * (e % 3 - 1), 0.02, len(days)))
        rows += [(f"E{e:02d}", d, float(c * 0.99), float(c * 1.02), float(c * 0.98), float(c), float(rng.integers(100, 900))) for d, c in zip(days, close, strict=True)]
    path = f"file:{tmp_path_factory.mktemp('bars')}/bars"
    spark.createDataFrame(rows, "entity string, date date, open double, high double, low double, close double, volume double").write.parquet(path)
    return path


@pytest.fixture(scope="module")
def base(spark, bars, tmp_path_factory):
    """Ten collected dates, one weekday of two left out."""
    root = f"file:{tmp_path_factory.mktemp('archive')}"
    table = spark.read.parquet(bars)
    some = table.select("entity").distinct().where("entity <> 'E35'")
    days = [d for (d,) in table.select("date").distinct().orderBy("date").collect()][100:118:2]
    for d in days:
        programs.collect(spark, f"{root}/a", table, d, f"{root}/out", some)
    return f"{root}/a", f"{root}/out", days


def text_of(spark, path):
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def test_collect(spark, bars, base):
    archive, out, days = base
    rows = store.load_features(spark, archive)
    assert rows.count() == 35 * len(days) and rows.where("score BETWEEN 0 AND 100 AND features['ret_63d'] IS NOT NULL AND size(components) = 10").count() == 35 * len(days)
    prices = store.load_prices(spark, archive)
    assert prices.agg(F.max("date")).first()[0] == days[-1] and prices.where("entity = 'E35'").isEmpty()
    assert prices.where("entity = 'E03'").count() == 10 + 2 * (len(days) - 1)
    assert "| entity | score |" in text_of(spark, f"{out}/rankings.md") and files.exists(spark, f"{out}/rankings/{days[-1]}")
    again = ["collect", archive, "--out", out, "--bars", bars, "--date", str(days[0]), "--skip-if-collected"]
    assert main(again, spark) == 0 and store.load_features(spark, archive).count() == rows.count()


def test_sources_win_and_see_no_future(spark, bars):
    table = spark.read.parquet(bars)
    universe = spark.createDataFrame([("E00",), ("E01",), ("NEW",)], "entity string")
    src = spark.createDataFrame([("E00", {"ret_5d": 9.0, "news_count": 3.0}), ("NEW", {"news_count": 1.0}), ("else", {"news_count": 7.0})], "entity string, features map<string,double>")
    day = dt.date(2026, 6, 1)
    got = {r["entity"]: r for r in programs.snapshot(table, day, universe, [src]).collect()}
    assert set(got) == {"E00", "E01", "NEW"} and got["E00"]["features"]["ret_5d"] == 9.0 and got["NEW"]["last_price"] is None
    cut = {r["entity"]: r for r in programs.snapshot(table.where(F.col("date") <= F.lit(day)), day, universe, [src]).collect()}
    assert got == cut


def test_evaluate_and_predict(spark, bars, base):
    archive, out, days = base
    store.upsert(spark, f"{archive}/prices", spark.read.parquet(bars).select(F.lit(2).alias("schema_version"), "date", "entity", "close"), store.PRICE)
    report = programs.evaluate(spark, archive, out, 21, (7, 21), names=("ret_5d", "ret_21d", "KMID", "news_count"))
    assert f"{35 * len(days)} labeled examples" in report and "| ret_21d |" in report and "| h7 |" in report and "news_count" not in report
    assert spark.read.json(f"{out}/labeled_21d").count() == 35 * len(days) and text_of(spark, f"{out}/eval_report.md").strip() == report.strip()
    table = programs.predict(spark, archive, out, 21, 5)
    assert "p_big" in table and table.split("# Evidence")[0].count(str(days[-1])) == 5 and "Top fifth:" in table
    assert "collecting" in programs.predict(spark, f"{archive}-none", out)
    assert "0 labeled" in programs.evaluate(spark, f"{archive}-none", out)


def test_evaluate_bars(spark, bars, base):
    report = programs.evaluate(spark, "unread", base[1], 10, names=("ret_5d", "rsi_14", "news_count"), bars=spark.read.parquet(bars))
    assert "| rsi_14 |" in report and "at 10 bars" in report and "Decay" not in report


def test_backfill_status_and_gate(spark, bars, base, capsys):
    archive, out, days = base
    table = spark.read.parquet(bars)
    missed = [str(d) for (d,) in table.where(F.col("date").between(days[0], days[-1])).select("date").distinct().orderBy("date").collect() if d not in days]
    assert programs.backfill(spark, archive, table, dry_run=True) == dict.fromkeys(missed, 35)
    assert programs.backfill(spark, archive, table, dates=[missed[0], days[0]]) == {missed[0]: 35}
    rows = store.load_features(spark, archive)
    assert rows.where("backfilled").select("date").distinct().count() == 1 and rows.where(F.col("date") == F.lit(days[0])).where("backfilled").isEmpty()
    state = programs.status(spark, archive, days[-1])
    assert state["gate"] == "OK" and state["archives"]["features"]["lag"] == 0
    assert main(["gate", archive], spark) == 0 and main(["gate", f"{archive}-none"], spark) == 1
    assert main(["compact", archive, "--out", f"{out}/flat"], spark) == 0
    capsys.readouterr()
    assert main(["sql", archive, "--out", f"{out}/flat", "SELECT count(*) AS n FROM features"], spark) == 0 and str(rows.count()) in capsys.readouterr().out
