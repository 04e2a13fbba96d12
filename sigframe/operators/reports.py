"""Markdown for people, from results that are already small (leaderboards, rankings, predictions, status)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

MOST_ROWS = 1000


def to_markdown(df: DataFrame, title: str, note: str = "", rows: int = MOST_ROWS) -> str:
    """A table of at most `rows` rows; numbers to four places, nulls as a dash."""

    def shown(v) -> str:
        return "–" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)

    lines = [f"# {title}", "", *([note, ""] if note else []), "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(shown, r)) + " |" for r in df.limit(rows).collect()), ""])


def weekdays_between(a: dt.date, b: dt.date) -> int:
    """Weekdays after a up to b."""
    return sum((a + dt.timedelta(days=k)).weekday() < 5 for k in range(1, (b - a).days + 1))


def status(manifest: DataFrame, today: dt.date, label_lag: int = 63, least_dates: int = 8) -> dict:
    """Per archive its rows and lag in weekdays (late from 2 on); when labels begin and whether dates suffice."""
    out: dict = {"archives": {}, "late": False}
    for r in manifest.collect():
        lag = weekdays_between(r["last_date"], today) if r["last_date"] else None
        out["archives"][r["archive"]] = {"rows": r["rows"], "dates": r["dates"], "entities": r["entities"], "lag": lag}
        out["late"] |= lag is None or lag >= 2
        if r["archive"] == "features":
            out["enough_dates"] = r["dates"] >= least_dates
            out["first_label"] = r["first_date"] + dt.timedelta(days=label_lag) if r["first_date"] else None
    return out
