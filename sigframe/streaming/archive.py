"""Streams into the archive, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sigframe.schema import PRICE
from sigframe.sources import store


def stream_prices(rows: DataFrame, base: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upserts each micro-batch of price rows; a batch that runs again writes the same archive."""

    def write(batch: DataFrame, _: int) -> None:
        store.upsert(batch.sparkSession, f"{base}/prices", batch.where("close > 0"), PRICE)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, ts: str, by: list[str], length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, by..., n, total over tumbling or sliding event-time windows; works on streams and tables."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(window, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")
