"""python -m sigframe {collect,evaluate,predict,gate,status,backfill,compact,sql} ARCHIVE ..."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from sigframe import programs
from sigframe.schema import DECAY_HORIZONS, HORIZON
from sigframe.session import get_spark
from sigframe.sources import warehouse


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sigframe", description="Runs over an archive of snapshots and prices.")
    p.add_argument("--master", help="of the session, where spark-submit doesn't name it")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, text: str, *, out: bool = False, bars: bool | None = None):
        v = verbs.add_parser(name, help=text)
        v.add_argument("archive")
        if out:
            v.add_argument("--out", required=True, help="folder of reports or tables")
        if bars is not None:
            v.add_argument("--bars", required=bars, help="Parquet: entity, date, open, high, low, close, volume")
        return v

    v = verb("collect", "append a date's snapshot and prices, rank it, check it", out=True, bars=True)
    v.add_argument("--date", default=dt.date.today().isoformat())
    v.add_argument("--universe", help="Parquet: entity")
    v.add_argument("--source", action="append", default=[], help="Parquet: entity, features (map); later ones win")
    v.add_argument("--skip-if-collected", action="store_true")
    v = verb("evaluate", "leaderboard, decay and walk forward", out=True, bars=False)
    v.add_argument("--horizon", type=int, default=HORIZON)
    v.add_argument("--horizons", default=",".join(map(str, DECAY_HORIZONS)))
    v = verb("predict", "rank the latest snapshot by learned probabilities", out=True)
    v.add_argument("--horizon", type=int, default=HORIZON)
    v.add_argument("--top", type=int, default=20)
    verb("gate", "whether the latest snapshot's sources are alive")
    verb("status", "rows, lags, labels").add_argument("--today", default=dt.date.today().isoformat())
    v = verb("backfill", "rebuild missed dates from bars", bars=True)
    v.add_argument("--since")
    v.add_argument("--until")
    v.add_argument("--dates", help="with commas")
    v.add_argument("--dry-run", action="store_true")
    verb("compact", "rebuild the Parquet warehouse", out=True)
    verb("sql", "query the warehouse's views", out=True).add_argument("query")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or get_spark("sigframe", a.master)

    def read(path: str | None) -> DataFrame | None:
        return spark.read.parquet(path) if path else None

    if a.verb == "collect":
        print(json.dumps(programs.collect(spark, a.archive, read(a.bars), a.date, a.out, read(a.universe), [read(s) for s in a.source], not a.skip_if_collected)))
    elif a.verb == "evaluate":
        print(programs.evaluate(spark, a.archive, a.out, a.horizon, tuple(int(h) for h in a.horizons.split(",")), bars=read(a.bars)))
    elif a.verb == "predict":
        print(programs.predict(spark, a.archive, a.out, a.horizon, a.top))
    elif a.verb == "status":
        print(json.dumps(programs.status(spark, a.archive, dt.date.fromisoformat(a.today)), default=str))
    elif a.verb == "backfill":
        print(json.dumps(programs.backfill(spark, a.archive, read(a.bars), a.since, a.until, a.dates.split(",") if a.dates else None, dry_run=a.dry_run)))
    elif a.verb == "compact":
        print(json.dumps(warehouse.compact(spark, a.archive, a.out)))
    elif a.verb == "sql":
        warehouse.frame(spark, a.out, a.query).show(1000, truncate=False)
    else:
        verdict, code, report = programs.gate(spark, a.archive)
        print(json.dumps({"verdict": verdict, "families": report}, default=str))
        return code
    return 0


if __name__ == "__main__":
    sys.exit(main())
