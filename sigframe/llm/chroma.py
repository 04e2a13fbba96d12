"""Chroma fingerprints of audio columns, and alignment of recordings by them.

Samples are cut into overlapping Hann frames; the power of each frame's spectrum is folded into 12
pitch classes, smoothed over 5 frames and normalised. On the integral image of these rows, filters
of adding and subtracting rectangles are evaluated at each frame; each gives two bits (Gray code of
four levels), 16 filters a packed 32-bit integer.

Recordings are linked by landmarks: `RUN` equal integers in a row, of which the least hash of each
`PICK` neighbours is kept, so that any RUN + PICK - 1 equal integers in a row share one. A landmark
proposes all pairs of its holders, whatever their number, and every pair that shares one is aligned: no link between
different recordings is left out. Pairs are never rows: recordings are dealt into tiles, in which every pair is aligned once, and a tile
hands on a row per recording: its links there, its best alignment and a root that it reaches over links. Comparing is quadratic in the
different recordings that share a landmark. Aligning counts the offsets of all landmarks that both hold, at all
their places; the highest bin is the alignment, and the bit errors over the whole overlap decide:
recordings are the same, are linked and join a group, where at most `SAME_ERRORS` of the bits differ and the
overlap is at least `COVER` of the shorter one.

Media here: a column of bytes, read as unsigned 8-bit mono samples (`pcm8`) or as little-endian
signed 16-bit ones (`pcm16`).

Cases: null and empty recordings have no integers, no links and a class of their own kind; shorter
ones are padded with silence to one landmark; silent frames have the zero chroma; equal rows fall
into one class and group; rows of equal id or of none are recordings of their own; class_id and
group_id are the least ids there, null where there are none; an empty table gives no rows; long
recordings are read in pieces; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import Cuts, components, numbered, small_batches

RATE, FRAME, HOP = 8000, 256, 64
LOWEST, HIGHEST = 60.0, 3600.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
WIDEST = 8
RUN, PICK = 4, 4
PIECE_FRAMES = 1 << 14
#: Two recordings are the same if so many of the compared bits differ at most, over so much of the shorter one.
SAME_ERRORS, COVER = 0.15, 0.5
#: Recordings and pairs that a tile has, about; so many tiles from which on their sizes grow as their number does.
BLOCK, TILE_PAIRS, MANY_TILES = 256, 4096, 256
#: Matches and compared integers that are held at once while a recording is aligned with others.
AT_ONCE = 1 << 20
#: Matches of one landmark in two recordings from which on their offsets are counted by a Fourier transform.
MANY_MATCHES = 1 << 14


@cache
def pitch_classes(rate: int, frame: int) -> np.ndarray:
    """(bins, 12): which class each spectrum bin feeds; class 9 holds A = 440 Hz."""
    hz = np.fft.rfftfreq(frame, 1 / rate)
    out = np.zeros((len(hz), 12))
    for k, f in enumerate(hz):
        if LOWEST <= f <= min(HIGHEST, rate / 2):
            out[k, (round(12 * np.log2(f / 440.0)) + 9) % 12] = 1
    return out


def chroma(samples: np.ndarray, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """(frames, 12) normalised rows, smoothed over time."""
    n = (len(samples) - frame) // hop + 1
    if n < len(SMOOTH):
        return np.zeros((0, 12))
    window, classes = np.hanning(frame), pitch_classes(rate, frame)
    rows = np.empty((n, 12))
    for at in range(0, n, PIECE_FRAMES):
        k = min(PIECE_FRAMES, n - at)
        piece = np.lib.stride_tricks.sliding_window_view(samples[at * hop : (at + k - 1) * hop + frame], frame)[::hop]
        spectrum = np.fft.rfft((piece - piece.mean(axis=1, keepdims=True)) * window, axis=1)
        rows[at : at + k] = (spectrum.real**2 + spectrum.imag**2) @ classes
    smooth = sum(w * rows[k : n - len(SMOOTH) + 1 + k] for k, w in enumerate(SMOOTH))
    norm = np.sqrt((smooth**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-9, smooth / np.maximum(norm, 1e-9), 0.0)


@cache
def filters() -> tuple[tuple[int, int, int, int], ...]:
    """16 filters (kind, first class, classes, frames), spread by rule over kinds, bands and widths."""
    out = []
    for k in range(16):
        height = 2 + 2 * (k % 3)
        out.append((k % 4, (5 * k) % (12 - height + 1), height, 2 + (3 * k) % (WIDEST - 1)))
    return tuple(out)


def pack(rows: np.ndarray) -> np.ndarray:
    """One 32-bit integer per frame that has WIDEST frames from it on."""
    n = len(rows) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(rows) + 1, 13))
    image[1:, 1:] = rows.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        """Sum over frames t + [x0, x1) and classes [y0, y1)."""
        return image[t + x1, y1] - image[t + x0, y1] - image[t + x1, y0] + image[t + x0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        whole = area(0, w, y, y + h)
        if kind == 0:  # lower against upper classes
            a = area(0, w, y, y + h // 2)
            b = whole - a
        elif kind == 1:  # earlier against later frames
            a = area(0, w // 2, y, y + h)
            b = whole - a
        elif kind == 2:  # opposite quarters
            a = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
            b = whole - a
        else:  # the band against the mean of all classes
            a, b = whole, area(0, w, 0, 12) * (h / 12)
        level = np.log((a + 0.05) / (b + 0.05))
        code = (level > -0.3).astype(np.uint32) + (level > 0) + (level > 0.3)
        out = (out << np.uint32(2)) | (code ^ (code >> np.uint32(1)))
    return out


def fingerprint(audio: bytes | None, kind: str = "pcm8", rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """The packed integers of a recording."""
    if not audio:
        return np.zeros(0, np.uint32)
    if kind == "pcm8":
        samples = np.frombuffer(audio, np.uint8).astype(np.float32) - 128
    else:
        samples = np.frombuffer(audio[: len(audio) // 2 * 2], "<i2").astype(np.float32)
    least = frame + hop * (len(SMOOTH) - 1 + WIDEST - 1 + RUN - 1)
    if len(samples) < least:
        samples = np.concatenate([samples, np.zeros(least - len(samples), np.float32)])
    return pack(chroma(samples, rate, frame, hop))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def landmarks(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the picked runs of integers."""
    n = len(ints) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(RUN):
        h = _mix(h ^ (ints[k : n + k].astype(np.uint64) + np.uint64(k + 1 << 40)))
    width = min(PICK, n)
    picked = np.lib.stride_tricks.sliding_window_view(h, width).argmin(axis=1) + np.arange(n - width + 1)
    at = np.unique(picked)
    return at, h[at]


def fingerprints(recordings: DataFrame, kind: str = "pcm8", rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> DataFrame:
    """Of row, id, audio binary: row, id, ints binary (packed integers, little-endian), mark (their digest)."""
    small_batches(recordings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [fingerprint(x, kind, rate, frame, hop).astype("<u4").tobytes() for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(made, pa.binary()), pa.array([hashlib.md5(m).hexdigest() for m in made], pa.string())], names=["row", "id", "ints", "mark"])

    rows = recordings.select("row", F.col("id").cast("long").alias("id"), F.col("audio").cast("binary").alias("audio"))
    return rows.mapInArrow(run, "row long, id long, ints binary, mark string")


def _holders(classes: DataFrame) -> DataFrame:
    """landmark, node: the different landmarks of each recording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.unique(landmarks(np.frombuffer(raw, "<u4"))[1])
                if len(h):
                    yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.full(len(h), node, np.int64))], names=["landmark", "node"])

    return classes.select("node", "ints").mapInArrow(run, "landmark long, node long")


def _shared(holders: DataFrame) -> DataFrame:
    """landmark, node, n: the landmarks of several recordings, with the number of these."""
    counts = holders.groupBy("landmark").agg(F.count("*").alias("n")).where("n > 1")
    return holders.join(counts.hint("merge"), "landmark")


def _sorts(held: DataFrame) -> int:
    """So many sorts of recordings that each two make a tile of about TILE_PAIRS pairs, or of BLOCK recordings where these have few partners.

    Of more than MANY_TILES tiles, pairs a tile and tiles both grow with the root of all pairs, so that a group of n is
    dealt in about n ** 1.5 rows. A recording's partners are counted by its commonest landmark.
    """
    seen = held.groupBy("node").agg((F.max("n") - 1).alias("partners")).agg(F.sum("partners").alias("ends"), F.count("*").alias("nodes")).first()
    tiles = (seen.ends or 0) / 2 / TILE_PAIRS
    tiles = max(min(tiles, np.sqrt(MANY_TILES * tiles)), seen.nodes / BLOCK)
    return max(1, int(np.ceil(np.sqrt(2 * tiles))))


def _dealt(held: DataFrame, sorts: int) -> DataFrame:
    """tile, own, facing, node: each recording once in every tile (two sorts, or one with itself) where it shares a landmark.

    Which sorts hold a landmark is told by bits, 64 in a word, so that neither landmarks nor recordings are paired with each other.
    """
    own = F.pmod(F.xxhash64("node"), F.lit(sorts)).cast("int")
    word = F.expr("CAST(own DIV 64 AS INT)")
    bit = F.expr("shiftleft(1L, own % 64)")
    counted = held.withColumn("own", own).groupBy("landmark", "own").agg(F.count("*").alias("c"))
    words = counted.groupBy("landmark", word.alias("word")).agg(F.bit_or(bit).alias("some"), F.bit_or(F.when(F.col("c") > 1, bit).otherwise(F.lit(0).cast("long"))).alias("several"))
    met = held.select("landmark", "node", own.alias("own")).join(words.hint("merge"), "landmark")
    mine = F.when(F.col("word") == word, bit).otherwise(F.lit(0).cast("long"))
    met = met.withColumn("mine", mine).withColumn("bits", F.expr("(some & ~mine) | (several & mine)"))  # its own sort only where another holder is in it
    met = met.groupBy("node", "own", "word").agg(F.bit_or("bits").alias("bits"))
    dealt = met.select("node", "own", F.expr("explode(transform(filter(sequence(0, 63), k -> getbit(bits, k) = 1), k -> word * 64 + k))").alias("facing"))
    return dealt.select((F.least("own", "facing").cast("long") * sorts + F.greatest("own", "facing")).alias("tile"), "own", "facing", "node")


def _by_hash(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the landmarks in the order of their hashes; the different hashes, where each begins and ends."""
    at, h = landmarks(ints)
    order = np.argsort(h, kind="stable")
    at, h = at[order], h[order]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return at, h[start], start, np.r_[start[1:], len(h)] if len(h) else start


def best_offset(x: np.ndarray, y: np.ndarray, marks: tuple | None = None, other_marks: tuple | None = None) -> tuple[int, int]:
    """(shift, votes): the commonest place less other place of landmarks in both; of equals the least shift, then the greater.

    `marks` are the landmarks by hash (`_by_hash`), where they are known.
    """
    at, h, start, end = marks or _by_hash(x)
    other_at, other_h, other_start, other_end = other_marks or _by_hash(y)
    size = len(x) + len(y)
    votes = np.zeros(2 * size, np.int64)
    _, i, j = np.intersect1d(h, other_h, assume_unique=True, return_indices=True)
    a0, a1, b0, b1 = start[i], end[i], other_start[j], other_end[j]
    wide_b = b1 - b0
    matches = (a1 - a0) * wide_b
    few = matches <= MANY_MATCHES
    for k in np.flatnonzero(~few):  # as in silence: the product would be all pairs of places
        wide = 1 << (size - 1).bit_length()
        here, there = np.zeros(wide), np.zeros(wide)
        here[at[a0[k] : a1[k]]] = 1
        there[other_at[b0[k] : b1[k]]] = 1
        count = np.rint(np.fft.irfft(np.fft.rfft(here) * np.conj(np.fft.rfft(there)), wide)).astype(np.int64)
        shift = np.arange(-len(y), len(x))
        votes[shift + size] += count[shift % wide]
    some = np.flatnonzero(few)
    for k in range(0, len(some), 64):  # so many landmarks at once
        part = some[k : k + 64]
        m = matches[part]
        own = np.arange(m.sum()) - np.repeat(m.cumsum() - m, m)
        each = np.repeat(wide_b[part], m)
        shift = at[np.repeat(a0[part], m) + own // each] - other_at[np.repeat(b0[part], m) + own % each]
        votes += np.bincount(shift + size, minlength=2 * size)
    best = np.flatnonzero(votes == votes.max()) - size
    best = best[np.abs(best) == np.abs(best).min()].max()
    return int(best), int(votes.max())


def _compared(x: np.ndarray, y: np.ndarray, marks: tuple, other_marks: tuple) -> tuple[int, int, int, int, bool]:
    """shift, votes, bit_errors, bits, same."""
    shift, votes = best_offset(x, y, marks, other_marks)
    least = min(len(x), len(y))
    x, y = x[max(0, shift) :], y[max(0, -shift) :]
    n = min(len(x), len(y))
    errors = int(np.bitwise_count(x[:n] ^ y[:n]).sum())
    return shift, votes, errors, 32 * n, errors <= SAME_ERRORS * 32 * n and n >= COVER * least


def _runs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these sizes laid end to end: the run of each place, and its place in the run."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return run, np.arange(len(run)) - np.repeat(sizes.cumsum() - sizes, sizes)


class Tile:
    """Recordings of different nodes, in the order of their nodes; aligns one of them with all lesser ones of a side at a time."""

    def __init__(self, nodes: np.ndarray, own: np.ndarray, facing: np.ndarray, ints: list[np.ndarray]):
        self.nodes, self.own, self.facing, self.ints = nodes, own, facing, ints
        self.marks = [_by_hash(x) for x in ints]
        self.lens = np.array([len(x) for x in ints])
        self.base = self.lens.cumsum() - self.lens
        self.flat = np.concatenate(ints)
        held = np.array([len(m[0]) for m in self.marks])
        self.at = np.concatenate([m[0] for m in self.marks])
        self.hash = np.concatenate([m[1] for m in self.marks])
        self.rec = np.repeat(np.arange(len(nodes)), [len(m[1]) for m in self.marks])
        self.start = np.concatenate([m[2] for m in self.marks]) + (held.cumsum() - held)[self.rec]
        self.count = np.concatenate([m[3] - m[2] for m in self.marks])
        self.sides = {}
        for side in np.unique(own):
            there = np.flatnonzero(own[self.rec] == side)
            there = there[np.argsort(self.hash[there], kind="stable")]
            self.sides[side] = there, self.hash[there]

    def _scored(self, a: int, entry: np.ndarray, mark: np.ndarray, other: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """shift, votes, bit errors, bits of `a` with each of `other`, whose entries (places of a landmark) begin at `first`."""
        at, _, start, end = self.marks[a]
        matches = (end - start)[mark] * self.count[entry]
        of, k = _runs(matches)
        each = self.count[entry][of]
        shift = at[start[mark][of] + k // each] - self.at[self.start[entry][of] + k % each]
        rank = (np.searchsorted(first, np.arange(len(entry)), "right") - 1)[of]
        most = int(max(self.lens[a], self.lens[other].max()))
        key, votes = np.unique(rank * (2 * most + 1) + shift + most, return_counts=True)
        rank, shift = key // (2 * most + 1), key % (2 * most + 1) - most
        order = np.lexsort((-shift, np.abs(shift), -votes, rank))
        order = order[np.searchsorted(rank[order], np.arange(len(other)))]
        shift, votes = shift[order], votes[order]
        here, there = np.maximum(shift, 0), np.maximum(-shift, 0)
        n = np.minimum(self.lens[a] - here, self.lens[other] - there)
        of, k = _runs(n)
        wrong = np.bitwise_count(self.ints[a][here[of] + k] ^ self.flat[(self.base[other] + there)[of] + k])
        return shift, votes, np.add.reduceat(wrong.astype(np.int64), n.cumsum() - n), 32 * n

    def aligned(self, a: int) -> tuple[np.ndarray, ...] | None:
        """other (its place in the tile), shift, votes, bit_errors, bits, same: `a` with every lesser recording it faces that shares a landmark."""
        if self.facing[a] not in self.sides:
            return None
        there, hashes = self.sides[self.facing[a]]
        lo, hi = (np.searchsorted(hashes, self.marks[a][1], side) for side in ("left", "right"))
        mark, k = _runs(hi - lo)
        entry = there[lo[mark] + k]
        lesser = self.rec[entry] < a
        mark, entry = mark[lesser], entry[lesser]
        if not len(entry):
            return None
        order = np.argsort(self.rec[entry], kind="stable")
        mark, entry = mark[order], entry[order]
        matches = (self.marks[a][3] - self.marks[a][2])[mark] * self.count[entry]
        first = np.flatnonzero(np.r_[True, self.rec[entry[1:]] != self.rec[entry[:-1]]])
        other, last = self.rec[entry[first]], np.r_[first[1:], len(entry)]
        work = np.add.reduceat(matches, first)
        alone = (np.maximum.reduceat(matches, first) > MANY_MATCHES) | (work > AT_ONCE)  # as in silence
        found = [np.zeros(len(other), np.int64) for _ in range(4)]
        for k in np.flatnonzero(alone):
            got = _compared(self.ints[a], self.ints[other[k]], self.marks[a], self.marks[other[k]])
            for column, value in zip(found, got, strict=False):
                column[k] = value
        some = np.flatnonzero(~alone)
        part = (work + np.minimum(self.lens[a], self.lens[other]))[some].cumsum() // AT_ONCE
        for chunk in np.split(some, np.flatnonzero(part[1:] != part[:-1]) + 1) if len(some) else ():
            of, k = _runs(last[chunk] - first[chunk])
            picked = first[chunk][of] + k
            begins = np.flatnonzero(k == 0)
            for column, value in zip(found, self._scored(a, entry[picked], mark[picked], other[chunk], begins), strict=True):
                column[chunk] = value
        shift, votes, errors, bits = found
        return other, shift, votes, errors, bits, (errors <= SAME_ERRORS * bits) & (bits >= COVER * 32 * np.minimum(self.lens[a], self.lens[other]))

    def summed(self) -> dict[str, list]:
        """A row per recording that is aligned here: its links, a root it reaches over them, and its best alignment with a lesser one."""
        n = len(self.nodes)
        links, root, best = np.zeros(n, np.int64), np.arange(n), [None] * n
        for a in range(n):
            if (got := self.aligned(a)) is None:
                continue
            other, shift, votes, errors, bits, same = got
            linked = other[same]
            links[a] += len(linked)
            links[linked] += 1
            if len(linked):
                roots = np.unique(root[np.r_[linked, a]])
                root[np.isin(root, roots)] = roots[0]
            k = np.lexsort((other, -votes, ~same))[0]
            best[a] = (int(self.nodes[other[k]]), int(shift[k]), int(votes[k]), int(errors[k]), int(bits[k]), bool(same[k]))
        rows = [k for k in range(n) if best[k] or links[k]]
        out = {"node": self.nodes[rows].tolist(), "root": self.nodes[root[rows]].tolist(), "links": links[rows].tolist()}
        for c, name in enumerate(("other", "shift", "votes", "bit_errors", "bits", "same")):
            out[name] = [best[k] and best[k][c] for k in rows]
        return out


def _aligned(held: DataFrame, classes: DataFrame) -> DataFrame:
    """node, root, links, other, shift, votes, bit_errors, bits, same: a row per recording and tile (`Tile.summed`).

    Every pair that shares a landmark meets in one tile, which gets the integers of each of its recordings once.
    """
    spark, sorts = held.sparkSession, _sorts(held)
    dealt = _dealt(held, sorts).join(classes.select("node", "ints").hint("merge"), "node").select("tile", "own", "facing", "node", "ints")
    tasks = min(sorts * (sorts + 1) // 2, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a number, as small tiles may be long work
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("other", pa.int64()), ("shift", pa.int32()), ("votes", pa.int64()), ("bit_errors", pa.int64()), ("bits", pa.int64()), ("same", pa.bool_())])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        own, facing = rows["own"].to_numpy(), rows["facing"].to_numpy()
        return pa.table(Tile(rows["node"].to_numpy(), own, facing, [np.frombuffer(x, "<u4") for x in rows["ints"].to_pylist()]).summed(), schema=schema)

    return dealt.repartition(tasks, "tile").groupBy("tile").applyInArrow(run, "node long, root long, links long, other long, shift int, votes long, bit_errors long, bits long, same boolean")


def align(recordings: DataFrame, kind: str = "pcm8", rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> DataFrame:
    """Of id, audio: a row per recording.

    id, n_ints, mark (digest of the integers), class_id (least id of equal integers), group_id (least
    id reachable over recordings that are the same), and its best alignment with an earlier recording of
    another fingerprint, null where there is none: other, shift (frames), votes, bit_errors, bits, same;
    links: the number of other fingerprints that are the same.
    """
    spark = recordings.sparkSession
    cuts = Cuts(spark, "chroma")
    small_batches(spark)
    rows = numbered(recordings.select("id", "audio"), cuts, "id")
    marked = cuts.write(fingerprints(rows, kind, rate, frame, hop))
    classes = cuts.write(marked.groupBy("mark").agg(F.min("row").alias("node"), F.min("id").alias("class_id"), F.min("ints").alias("ints")))
    holders = cuts.write(_holders(classes))
    held = cuts.write(_shared(holders))
    cuts.drop(holders)
    aligned = cuts.write(_aligned(held, classes))
    cuts.drop(held)
    roots = components(aligned.select(F.col("node").alias("a"), F.col("root").alias("b")), cuts)
    best = aligned.where("other IS NOT NULL").groupBy("node").agg(F.max(F.struct("same", "votes", (-F.col("other")).alias("less"), "other", "shift", "bit_errors", "bits")).alias("x"))
    best = best.select("node", "x.other", "x.shift", "x.votes", "x.bit_errors", "x.bits", "x.same")
    linked = aligned.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("mark", "node", "class_id").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = cuts.write(named.groupBy("root").agg(F.min("class_id").alias("group_id")))
    best = best.join(classes.select(F.col("node").alias("other"), F.col("class_id").alias("other_id")).hint("merge"), "other").drop("other").withColumnRenamed("other_id", "other")
    per_class = cuts.write(named.join(groups.hint("merge"), "root").join(best.hint("merge"), "node", "left").join(linked.hint("merge"), "node", "left").fillna(0, ["links"]).drop("root", "node"))
    cuts.only(marked, per_class)
    out = marked.join(per_class.hint("merge"), "mark").withColumn("n_ints", (F.length("ints") / 4).cast("long"))
    return out.select("id", "n_ints", "mark", "class_id", "group_id", "other", "shift", "votes", "bit_errors", "bits", "same", "links")
