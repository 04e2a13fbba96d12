"""Repeated passages: every byte covered by a string of `LENGTH` bytes that also starts elsewhere.

Prefix doubling over sampled positions. A position's name at a length says which string of that
length starts there; names of pairs give names of longer strings; positions whose name is unique
drop out. Doing this for all positions would move each byte's row (position and name, 20 bytes)
through a shuffle in every round, so positions are sampled by content first: of the GRAM-byte grams
of each LENGTH-byte window the one with the least hash (the leftmost of equal ones) is its anchor,
and equal windows have equal anchors at equal offsets. Then

1. Spark names each anchor by its gram (73 bytes). Anchors of unique grams drop out, and with them
   all their windows.
2. Anchors are named by the pair (gram, reach): the reach is the string of all windows that the
   anchor stands for (up to 327 bytes). If a reach comes twice, all its windows repeat; one of the
   equal reaches stays as a witness for the others' neighbours.
3. The rest, mostly ends of passages, and the witnesses go on with their bytes, in rounds at growing
   lengths: the windows of a gram that start next to each other (`WIDTHS`: groups of 16, then of 1)
   are named by what they all hold (185 bytes, then LENGTH) and by all that they cover. Equal covers
   repeat wholly, and one stays as a witness; groups whose common bytes are unique drop out; the
   others are divided and ranked anew. Every gram takes this way, whatever its number of rows: a hot
   one is counted in part before its rows move, and the join that follows can be split.

Names are 64-bit polynomial hashes, mixed; a claim of equality always rests on two of them (gram and
window, cover or reach). Spans of equal windows are joined per document and cut from the bytes.

Cases: a null text counts as empty; texts shorter than LENGTH repeat nothing by themselves; equal
rows repeat each other wholly; matches may overlap, in one document too; a document of any length is
read in pieces that overlap by LENGTH - 1; rows of equal doc_id are kept apart by an inner number of
their own; a run of one byte has an anchor per byte, as its windows are all equal; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import Cuts, small_batches

LENGTH = 200
WINDOW = 128  # grams of a window
#: Windows of a group in each round of the last step: names of 185 bytes, then of LENGTH.
WIDTHS = (16, 1)
PIECE = 1 << 19
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


class Names:
    """Hashes of all substrings of a piece of text."""

    table = np.random.default_rng(17).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def powers(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, 1 << 16)
            cls.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _ODD, np.uint64)])
            cls.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _INVERSE, np.uint64)])

    def __init__(self, raw: np.ndarray):
        self.powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.table[raw] * self.up[: len(raw)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        """Mixed names of the substrings [start, end)."""
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(x + (np.asarray(end) - np.asarray(start)).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by running minima inside blocks in both directions."""
    n = len(x) - width + 1
    pad = -len(x) % width
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).reshape(-1)
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(raw: bytes, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Of a text: anchor positions, first and last window start of each, gram names, reach names.

    An anchor that a later piece finds again comes twice, with its windows shared out.
    """
    gram = length - window + 1
    out = []
    for base in range(0, max(1, len(raw) - length + 1), PIECE - length + 1):
        piece = np.frombuffer(raw, np.uint8, count=min(PIECE, len(raw) - base), offset=base)
        if len(piece) < length:
            break
        names = Names(piece)
        at = np.arange(len(piece) - gram + 1)
        grams = names.of(at, at + gram)
        low = _least_of((grams >> np.uint64(20) << np.uint64(20)) | at.astype(np.uint64), window)
        anchor = (low & np.uint64(0xFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        ends = np.r_[starts[1:], len(anchor)] - 1
        a = anchor[starts]
        out.append((a + base, starts + base, ends + base, grams[a], names.of(starts, ends + length) ^ mix((a - starts).astype(np.uint64))))
    if not out:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _numbered(docs: DataFrame, cuts: Cuts) -> DataFrame:
    """doc_id, raw (UTF-8), row: a number for each row, by doc_id where that is unique."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("raw"))
    repeated = rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if repeated.isEmpty():
        return rows.withColumn("row", F.col("doc_id"))
    return cuts.write(rows.withColumn("row", F.monotonically_increasing_id()))


def _anchor_rows(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, row = [], []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = anchors(raw)
                got.append(found)
                row.append(np.full(len(found[0]), k, np.int64))
            if not got:
                continue
            a, s, e, g, r = (np.concatenate(x) for x in zip(*got, strict=True))
            row = np.concatenate(row)
            for at in range(0, max(1, len(a)), 1 << 16):
                w = slice(at, at + (1 << 16))
                yield pa.record_batch([pa.array(row[w]), pa.array(a[w].astype(np.int32)), pa.array((a - s)[w].astype(np.int16)), pa.array((a - e)[w].astype(np.int16)), pa.array(g[w].view(np.int64)), pa.array(r[w].view(np.int64))], names=["row", "at", "most", "least", "gram", "reach"])

    return rows.select("row", "raw").mapInArrow(run, "row long, at int, most short, least short, gram long, reach long")


def _context_rows(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """The bytes of each anchor's reach, next to its row. `open_`: one row per document with anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = b.column(1).to_pylist()
            found = b.column(2).to_pylist()
            for at in range(0, len(raws), 64):
                out = [(row, x["at"], x["most"], x["least"], x["gram"], raw[x["at"] - x["most"] : x["at"] - x["least"] + LENGTH]) for row, raw, some in zip(b.column(0).to_pylist()[at : at + 64], raws[at : at + 64], found[at : at + 64], strict=True) for x in some]
                if out:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    schema = pa.schema([("row", pa.int64()), ("at", pa.int32()), ("most", pa.int16()), ("least", pa.int16()), ("gram", pa.int64()), ("bytes", pa.binary())])
    joined = rows.select("row", "raw").join(open_, "row").select("row", "raw", "found")
    return joined.mapInArrow(run, "row long, at int, most short, least short, gram long, bytes binary")


def _named(contexts: DataFrame, width: int, before: int) -> DataFrame:
    """Rows of groups of `width` neighbouring windows, out of each context's `parts` of `before` windows.

    (id, row, start, stop, gram, part, core, whole): `part` says which offsets of the gram in its window the
    group has; `core` names the bytes that all windows of such a group hold, `whole` those of this
    context's windows together. Both are the same at width 1: the window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            id_, row, at, most, least, gram = (b.column(k).to_numpy().astype(np.int64) for k in range(6))
            raw, parts = b.column(6).to_pylist(), b.column(7)
            sizes = np.array([len(x) for x in raw], np.int64)
            names = Names(np.frombuffer(b"".join(raw), np.uint8))
            anchor = np.cumsum(sizes) - sizes + most
            many = np.diff(parts.offsets.to_numpy()).astype(np.int64)
            owner, old = np.repeat(np.arange(len(raw)), many), parts.flatten().to_numpy().astype(np.int64)
            low, high = np.maximum(least[owner], old * before), np.minimum(most[owner], old * before + before - 1)
            first = low // width
            many = high // width - first + 1
            part = np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            low, high = np.maximum(np.repeat(low, many), part * width), np.minimum(np.repeat(high, many), part * width + width - 1)
            owner = np.repeat(owner, many)
            core = names.of(anchor[owner] - part * width, anchor[owner] - (part + 1) * width + 1 + LENGTH)
            whole = names.of(anchor[owner] - high, anchor[owner] - low + LENGTH) ^ mix((low * WINDOW + high).astype(np.uint64))
            columns = [id_[owner], row[owner], at[owner] - high, at[owner] - low + LENGTH, gram[owner], part.astype(np.int16), core.view(np.int64), whole.view(np.int64)]
            yield pa.record_batch([pa.array(c) for c in columns], names=["id", "row", "start", "stop", "gram", "part", "core", "whole"])

    columns = contexts.select("id", "row", "at", "most", "least", "gram", "bytes", "parts")
    return columns.mapInArrow(run, "id long, row long, start long, stop long, gram long, part short, core long, whole long")


def _spans_of(contexts: DataFrame, cuts: Cuts) -> list[DataFrame]:
    """Spans of the windows that contexts share: rounds of naming, counting and dropping unique names."""
    spans, now, before = [], contexts.withColumn("parts", F.array(F.lit(0).cast("short"))), WINDOW
    for width in WIDTHS:
        rows = cuts.write(_named(now, width, before))
        # one of the equal groups goes on as a witness for the others
        classes = cuts.write(rows.groupBy("gram", "part", "core", "whole").agg(F.count("*").alias("n"), F.min("id").alias("id")))
        equal = classes.where("n > 1").select("gram", "part", "whole")
        spans.append(rows.join(equal.hint("merge"), ["gram", "part", "whole"]).select("row", "start", "stop"))
        if width > 1:
            shared = cuts.write(classes.groupBy("gram", "part", "core").agg(F.count("*").alias("m")).where("m > 1").drop("m"))
            left = classes.join(shared.hint("merge"), ["gram", "part", "core"])
            parts = left.groupBy("id").agg(F.collect_list("part").alias("parts"))
            now, before = contexts.join(cuts.write(parts).hint("merge"), "id"), width
    return spans


def repeated_spans(rows: DataFrame, cuts: Cuts) -> DataFrame:
    """(row, start, stop): spans of bytes covered by repeated strings, in parts that may overlap."""
    small_batches(rows.sparkSession)
    marks = cuts.write(_anchor_rows(rows))
    # what is joined to many rows of a key is written first: adaptive execution then splits a hot key's rows
    grams = cuts.write(marks.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    common = cuts.write(marks.join(grams.hint("merge"), "gram"))
    cuts.drop(marks)
    cuts.drop(grams)
    reaches = cuts.write(common.groupBy("gram", "reach", "most", "least").agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("witness")))
    whole = cuts.write(reaches.where("n > 1").select("gram", "reach", "most", "least"))
    done = common.join(whole.hint("merge"), ["gram", "reach", "most", "least"]).select("row", (F.col("at") - F.col("most")).cast("long").alias("start"), (F.col("at") - F.col("least") + LENGTH).cast("long").alias("stop"))
    # one of each reach goes on; a gram with a single reach is settled
    several = cuts.write(reaches.groupBy("gram").agg(F.count("*").alias("reaches")).where("reaches > 1").select("gram"))
    left = cuts.write(reaches.join(several.hint("merge"), "gram").select("gram", "most", "least", "witness.row", "witness.at"))
    by_row = left.groupBy("row").agg(F.collect_list(F.struct("at", "most", "least", "gram")).alias("found"))
    contexts = cuts.write(_context_rows(rows, by_row).withColumn("id", F.monotonically_increasing_id()))
    small_batches(rows.sparkSession, 2048)
    found = done
    for spans in _spans_of(contexts, cuts):
        found = found.union(spans)
    found = cuts.write(found)
    cuts.only(found, *[t for t, _ in cuts.tables if t is rows])
    return found


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Of doc_id, text: doc_id, n_bytes, n_removed, n_spans, kept (bytes that stay), per document."""
    spark = docs.sparkSession
    cuts = Cuts(spark, "repeats")
    rows = _numbered(docs, cuts)
    spans = repeated_spans(rows, cuts)
    per_row = spans.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, raw, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                cut, kept, at = _joined([(x["start"], x["stop"]) for x in spans or []]), [], 0
                for start, stop in cut:
                    kept.append(raw[at:start])
                    at = stop
                kept.append(raw[at:])
                out.append((doc_id, len(raw), sum(stop - start for start, stop in cut), len(cut), b"".join(kept)))
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    joined = rows.join(per_row, "row", "left").select("doc_id", "raw", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
