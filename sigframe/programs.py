"""Whole runs over an archive: collect, evaluate, predict, gate, status, backfill. `python -m sigframe` calls them.

Bars (entity, date, open, high, low, close, volume) and the sources' frames (entity, features map) are
tables that the caller has landed. What a run prints or writes as Markdown is small: rankings, leaderboards,
predictions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.operators import backfill as B
from sigframe.operators import evaluate as E
from sigframe.operators import features as W
from sigframe.operators import labels as L
from sigframe.operators import model, quality, reports
from sigframe.operators.relational import merge_sources
from sigframe.operators.scoring import composite_score, ranked
from sigframe.operators.temporal import missing_business_days, row_offset_label, universe_carry
from sigframe.schema import BASE_FEATURES, DECAY_HORIZONS, FEATURES, HORIZON, PRICE, SCHEMA_VERSION, SCORE_WEIGHTS
from sigframe.session import kept
from sigframe.sources import files, store

#: Bars that a run reads and closes that it archives: days before the date, bars of an entity.
HISTORY_DAYS, PANEL_BARS = 400, 10
#: What bars alone give.
PRICE_SIGNALS = tuple(n for n in B.REBUILT if n != "short_vol_ratio")


def wide(snapshots: DataFrame, names: tuple = FEATURES) -> DataFrame:
    """Snapshots with a column per feature."""
    cols = [F.try_element_at("features", F.lit(n)).alias(n) for n in names]
    return snapshots.select("date", "entity", "score", "last_price", F.coalesce("backfilled", F.lit(False)).alias("backfilled"), *cols)


def recent(bars: DataFrame, date) -> DataFrame:
    """The bars of the last `HISTORY_DAYS` days up to a date; the bounds reach the scan."""
    day = F.lit(str(date)).cast("date")
    return bars.where((F.col("date") <= day) & (F.col("date") > F.date_sub(day, HISTORY_DAYS)))


def snapshot(bars: DataFrame, date, universe: DataFrame, sources: list[DataFrame] = ()) -> DataFrame:
    """The scored rows of one date: features at each entity's last bar up to it, the sources' laid over them.

    Entities of the universe without bars are rows too, as the sources may know them.
    """
    day = F.lit(str(date)).cast("date")
    last = W.last_rows(W.compute_features(recent(bars, date)), 1)
    made = F.map_from_arrays(F.array(*[F.lit(n) for n in PRICE_SIGNALS]), F.array(*[F.col(n).cast("double") for n in PRICE_SIGNALS]))
    known = last.select("entity", F.map_filter(made, lambda _, v: v.isNotNull()).alias("features"))
    rows = merge_sources(universe, [known, *sources]).join(last.select("entity", F.col("close").alias("last_price")), "entity", "left")
    rows = rows.select(day.alias("date"), "entity", "last_price", "features", *[F.try_element_at("features", F.lit(n)).alias(n) for n in BASE_FEATURES])
    parts = F.map_from_arrays(F.array(*[F.lit(k) for k in SCORE_WEIGHTS]), F.array(*[F.col(k) for k in SCORE_WEIGHTS]))
    return composite_score(rows).select("date", "entity", F.round("score", 4).alias("score"), "last_price", parts.alias("components"), "features")


def collect(spark: SparkSession, base: str, bars: DataFrame, date, out: str, universe: DataFrame | None = None, sources: list[DataFrame] = (), again: bool = True, top: int = 25) -> dict | None:
    """Appends a date's snapshot and the last ten closes, writes the ranking; how many rows were written.

    universe: entity; else all with a bar. Closes are kept for every entity ever tracked, so that labels
    outlive its place in the universe; writing ten anew mends late ones and touches one or two months. None, and nothing done, if the date is there and `again` is false.
    """
    if not again and store.has_snapshot(spark, base, date):
        return None
    universe = (bars if universe is None else universe).select("entity").distinct()
    rows = kept(snapshot(bars, date, universe, sources), "snapshot")
    wrote, _ = store.append_snapshot(spark, base, rows)
    followed = store.tracked(spark, base).union(universe).distinct()
    closes = W.last_rows(recent(bars, date).where("close > 0"), PANEL_BARS).join(followed, "entity", "left_semi")
    _, prices = store.upsert(spark, f"{base}/prices", closes.select(F.lit(SCHEMA_VERSION).alias("schema_version"), "date", "entity", F.col("close").cast("double").alias("close")), PRICE)
    store.write_manifest(spark, base)
    rows.write.mode("overwrite").json(f"{out}/rankings/{date}")
    shown = ["ret_21d", "ret_63d", "volume_spike_ratio", "news_count", "reddit_mentions"]
    best = ranked(rows, top).select("entity", "score", *[F.try_element_at("features", F.lit(n)).alias(n) for n in shown])
    files.write_text(spark, f"{out}/rankings.md", reports.to_markdown(best, "Rankings", f"{date}, {wrote} entities."))
    return {"features": wrote, "prices": prices}


def compiled(spark: SparkSession, base: str, horizon: int = HORIZON) -> DataFrame:
    """Snapshots with a column per feature, their forward return and its distance from the date's median."""
    return L.relative_return(L.label_snapshots(wide(store.load_features(spark, base)), store.load_prices(spark, base).select("entity", "date", "close"), horizon))


def _evidence(labeled: DataFrame, keys: list[str]) -> str:
    """What a walk forward finds out of sample; one aggregate."""
    oos = model.walk_forward(labeled, keys)
    if oos.isEmpty():
        return "Too few examples for a walk forward."
    found = model.evaluate_calibration(kept(oos, "oos")).first()
    shown = lambda v: "unknown" if v is None else f"{v:.4f}"
    return "Too few out-of-sample rows." if found is None else f"Out of sample: {found['n']} rows, Brier {shown(found['brier'])}, AUC {shown(found['auc'])}."


def _living(labeled: DataFrame, names: tuple) -> list[str]:
    """The names that have any value: one aggregate."""
    seen = labeled.agg(*[F.count(n).alias(n) for n in names]).first()
    return [n for n in names if seen[n]]


def evaluate(spark: SparkSession, base: str, out: str, horizon: int = HORIZON, horizons: tuple = DECAY_HORIZONS, names: tuple = FEATURES, bars: DataFrame | None = None) -> str:
    """Leaderboard, decay and a walk forward as Markdown, also at out/eval_report.md; the labelled rows go to the gold sink.

    With bars the archive is not read: every fifth bar's features against the close `horizon` bars on, no decay.
    """
    if bars is not None:
        names = tuple(n for n in names if n in PRICE_SIGNALS)
        found = row_offset_label(W.compute_features(bars), horizon).withColumn("horizon_days", F.lit(horizon * 7 // 5))
    else:
        found = compiled(spark, base, horizon)
    labeled = kept(found, "labeled")
    rows = labeled.count()
    note = f"{rows} labeled examples at {horizon} {'bars' if bars is not None else 'days'}."
    if not rows:
        text = f"# Signals\n\n{note} Collect for longer.\n"
        files.write_text(spark, f"{out}/eval_report.md", text)
        return text
    signals = _living(labeled, (*names, "score") if bars is None else names)
    text = reports.to_markdown(E.leaderboard(labeled, signals), "Signals", note)
    if bars is None:
        quality.write_gold(labeled, list(names), out, horizon)
        decay = E.ic_decay(wide(store.load_features(spark, base)), store.load_prices(spark, base).select("entity", "date", "close"), signals, horizons)
        text += "\n" + reports.to_markdown(decay, "Decay")
    text += f"\n# Walk forward\n\n{_evidence(L.top_quantile(labeled), [n for n in signals if n != 'score'])}\n"
    files.write_text(spark, f"{out}/eval_report.md", text)
    return text


def predict(spark: SparkSession, base: str, out: str, horizon: int = HORIZON, top: int = 20) -> str:
    """The latest snapshot's entities by the probability of the top fifth among their peers and of a big move, as
    Markdown, also at out/predictions.md; or what is missing. Both models' walk forwards are the evidence."""
    labeled = kept(L.top_quantile(compiled(spark, base, horizon), "rel_ret"), "labeled")
    ready, why = model.readiness(labeled)
    live = labeled.where("NOT backfilled")
    snapshots = wide(store.load_features(spark, base))
    keys = _living(live, FEATURES) if ready else []
    found = model.predict(live, snapshots, keys, top) if ready else None
    if found is None:
        text = f"# Predictions\n\n{why if not ready else model.readiness(live)[1]}\n"
    else:
        shown = found.withColumnRenamed("score", "model").join(snapshots.select("date", "entity", F.col("score").alias("heuristic")), ["date", "entity"], "left")
        text = reports.to_markdown(shown.orderBy(F.col("p").desc(), F.col("model").desc(), "entity"), "Predictions", f"{horizon} days ahead.")
        text += f"\n# Evidence\n\nTop fifth: {_evidence(live, keys)}\n\nBig move: {_evidence(live.withColumn('label', L.big_move()), keys)}\n"
    files.write_text(spark, f"{out}/predictions.md", text)
    return text


def gate(spark: SparkSession, base: str) -> tuple[str, int, list[dict]]:
    """Verdict, exit code and the latest date's families."""
    return quality.gate_verdict(store.load_features(spark, base))


def status(spark: SparkSession, base: str, today: dt.date) -> dict:
    """Rows and lags of both archives, when labels begin, and the gate's verdict."""
    return reports.status(store.update_manifest(spark, base), today) | {"gate": gate(spark, base)[0]}


def backfill(spark: SparkSession, base: str, bars: DataFrame, since=None, until=None, dates: list | None = None, short: DataFrame | None = None, dry_run: bool = False) -> dict[str, int]:
    """Rows per missed date, rebuilt from bars up to it for the entities of the last snapshot before (else of the
    latest); dates that have a snapshot are left alone.

    dates, or the weekdays from `since` (else the first snapshot) to `until` (else the last). A job per date;
    with dry_run nothing is written.
    """
    have = kept(store.load_features(spark, base).select("date", "entity").distinct(), "have")
    if dates is not None:
        wanted = spark.createDataFrame([(str(x),) for x in dates], "date string").select(F.col("date").cast("date")).distinct()
        gaps = wanted.join(have.select("date").distinct(), "date", "left_anti")
    else:
        bound = lambda x, other: other if x is None else F.lit(str(x)).cast("date")
        gaps = missing_business_days(have, bound(since, F.min("date")), bound(until, F.max("date")))
    carried = kept(universe_carry(gaps, have), "carried")
    out = {}
    for (day,) in carried.select("date").distinct().orderBy("date").collect():  # calendar days
        rows = B.snapshot_asof(bars, day, carried.where(F.col("date") == F.lit(day)), short)
        out[str(day)] = rows.count() if dry_run else store.append_snapshot(spark, base, rows)[0]
    return out


