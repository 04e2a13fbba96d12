"""SimHash near-duplicates, compared bit-sliced.

A fingerprint bit is 1 if it is set in more than half of the hashes of a text's word shingles.
Candidates share a key; inside a bucket of equal keys distances are counted vertically: bit plane j
holds bit j of 64 fingerprints a word, planes of two fingerprint blocks are xor-ed, and carry-save
adders add them to counters that hold one bit of 64 distances a word. A counter that passes the
radius sets a sticky bit; words whose 64 lanes all have it are abandoned between groups of planes.

Two kinds of keys. For narrow radii, `exact_masks` cuts the bits into blocks so that any two
fingerprints within the radius agree on one table's blocks: no link is lost. For sets of similarity
s, `KEYS` least hashes of the set: two sets share one of them with probability 1 - (1 - s) ** KEYS
(0.99994 at 0.8), however many sets there are, and the rows grow as the sets do.

A crowded bucket, of over `CROWD` blocks of `BLOCK` fingerprints, is first cut by further keys of its
own kind: the bits that its mask left in radius + 1 parts, or the next `KEYS` least hashes. What is
still larger than a block is cut into blocks by hash and its pairs of blocks go to different tasks,
so that no bucket gathers in one; each task reports a spanning forest of its links, not all pairs.
Equal fingerprints count once. Components come from written tables.

Cases: null texts count as empty; a text with fewer words than a shingle is one shingle, one without
words has the fingerprint zero. In `near_duplicates` rows of equal doc_id are one document, which links
all their texts; so are those of null doc_id, which stands below all others and comes out null; in
`similar_documents` rows are told apart by their number. An empty table gives no rows; texts of any
length are read in pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import Cuts, among, components, small_batches

SEED = 42
#: Fingerprints of a bucket that one task compares with each other or with as many others; blocks from which
#: on a bucket is cut by further keys.
BLOCK, CROWD = 2048, 8
#: Least hashes of a set that are its keys; how often crowded buckets are cut by as many further ones.
KEYS, DEEPER = 6, 2
#: Rows that a task gathers before it compares their buckets.
GATHER = 1 << 15
#: Shingle hashes that a block of a proposed group holds; 16 MB.
GATHER_HASHES = 1 << 21
_NULL_ID = -(1 << 63)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LONG = 1 << 22
_GOLDEN = 0x9E3779B97F4A7C15


def _words(text: bytes, more: int) -> Iterator[list[bytes]]:
    """The words of a text; of a very long one in pieces that overlap by `more` words."""
    if len(text) < _LONG:
        yield text.split()
        return
    piece: list[bytes] = []
    cut = False
    for m in _WORD.finditer(text):
        piece.append(m[0])
        if len(piece) >= 1 << 18:
            yield piece
            piece = piece[len(piece) - more :] if more else []
            cut = True
    if len(piece) > more or not cut:
        yield piece


def shingle_hashes(text: str | None, n: int = 3) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each n-word shingle of the lower-cased text."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    digest = xxhash.xxh64_intdigest
    for words in _words(raw, n - 1):
        if len(words) < n:
            yield np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
        else:
            yield np.array([digest(x, SEED) for x in map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False))], np.uint64)


def fingerprint(text: str | None, n: int = 3, lanes: int = 1) -> bytes:
    """64 * lanes bits, little-endian; lanes after the first mix the same hashes."""
    return _majority(shingle_hashes(text, n), lanes)


def _majority(pieces: Iterable[np.ndarray], lanes: int) -> bytes:
    ones, total = np.zeros(64 * lanes, np.int64), 0
    for hashes in pieces:
        for at in range(0, len(hashes), 8192):
            h = hashes[at : at + 8192]
            if lanes > 1:
                more = h[:, None] + np.arange(1, lanes, dtype=np.uint64)[None, :] * np.uint64(_GOLDEN)
                more = (more ^ (more >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                more = (more ^ (more >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h = np.concatenate([h[:, None], more ^ (more >> np.uint64(31))], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int32)
            total += len(h)
    return np.packbits(ones * 2 > total, bitorder="little").tobytes()


def exact_masks(bits: int, radius: int, count: int, most: int = 4) -> list[np.ndarray]:
    """Tables of bit places; two fingerprints within `radius` agree on all places of one table.

    radius + m blocks, of which some m agree. m grows with the number of fingerprints so that
    buckets of random fingerprints stay within a few rows.
    """
    m = 1
    while m < most and count >> (bits * m // (radius + m)) > 8:
        m += 1
    blocks = np.array_split(np.arange(bits), radius + m)
    return [np.concatenate([blocks[k] for k in pick]) for pick in combinations(range(radius + m), m)]


def _planes(rows: np.ndarray) -> np.ndarray:
    """(fingerprints, bytes) to bit planes: (bits, words of 64 fingerprints)."""
    n = -(-len(rows) // 64) * 64
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    wide = np.zeros((bits.shape[1], n), np.uint8)
    wide[:, : len(rows)] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


class Counters:
    """Vertical counters of as many distances as there are lanes; `over` marks those past the radius."""

    def __init__(self, words: int, radius: int):
        self.levels = max(1, radius.bit_length())
        start = (1 << self.levels) - 1 - radius  # one more than the radius overflows
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.count = [np.full(words, full if start >> k & 1 else 0, np.uint64) for k in range(self.levels)]
        self.over = np.zeros(words, np.uint64)

    def add_two(self, x: np.ndarray, y: np.ndarray) -> None:
        """A carry-save full adder takes two planes into the ones; the carry ripples up."""
        ones = self.count[0]
        half = ones ^ x
        carry = (ones & x) | (half & y)
        self.count[0] = half ^ y
        for k in range(1, self.levels):
            now = self.count[k]
            self.count[k], carry = now ^ carry, now & carry
        self.over |= carry

    def keep(self, words: np.ndarray) -> None:
        self.count = [c[words] for c in self.count]
        self.over = self.over[words]


def _within(xors, bits: int, words: int, radius: int, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Words that have lanes within the radius, and those lanes. xors(plane, words) gives xor words."""
    live, counters = None, Counters(words, radius)
    for plane in range(0, bits, 2):
        counters.add_two(xors(plane, live), xors(plane + 1, live))
        if plane % step == step - 2:
            left = np.flatnonzero(counters.over != np.uint64(0xFFFFFFFFFFFFFFFF))
            if not len(left):
                return left, left.astype(np.uint64)
            if 4 * len(left) < 3 * len(counters.over):
                counters.keep(left)
                live = left if live is None else live[left]
    return np.arange(words) if live is None else live, ~counters.over


def _lanes(words: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into words, lane) of each set bit."""
    some = np.flatnonzero(masks)
    bits = np.unpackbits(masks[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(bits)
    return words[some[at]], lane


def near_in_group(rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, within the radius in one group: blocks of queries against all planes."""
    planes, n = _planes(rows), len(rows)
    words, left, right = planes.shape[1], [], []
    for at in range(0, n, 256):
        own = np.unpackbits(rows[at : at + 256], axis=1, bitorder="little").T.astype(np.uint64) * np.uint64(0xFFFFFFFFFFFFFFFF)
        first, width = at // 64, words - at // 64

        def xors(plane: int, live: np.ndarray | None, own=own, first=first, width=width) -> np.ndarray:
            if live is None:
                return (planes[plane, first:][None, :] ^ own[plane][:, None]).reshape(-1)
            return planes[plane, first + live % width] ^ own[plane, live // width]

        word, lane = _lanes(*_within(xors, len(planes), own.shape[1] * width, radius))
        i, j = at + word // width, (first + word % width) * 64 + lane
        keep = (i < j) & (j < n)
        left.append(i[keep])
        right.append(j[keep])
    return np.concatenate(left), np.concatenate(right)


def near_in_small_groups(rows: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius in many small groups at once: rows, sorted by group, against the
    same rows shifted by 1, 2, ... places; later shifts keep only the groups that are longer."""
    at, left, right, shift = np.arange(len(rows)), [], [], 0
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    size_of = np.repeat(sizes, sizes)
    while True:
        shift += 1
        keep = size_of[at] > shift
        if not keep.any():
            break
        at = at[keep]
        a, b = at[:-shift], at[shift:]
        same = group[a] == group[b]
        a, b = a[same], b[same]
        p, q = _planes(rows[a]), _planes(rows[b])

        def xors(plane: int, live: np.ndarray | None, p=p, q=q) -> np.ndarray:
            return p[plane] ^ q[plane] if live is None else p[plane, live] ^ q[plane, live]

        word, lane = _lanes(*_within(xors, len(p), p.shape[1], radius))
        k = word * 64 + lane
        k = k[k < len(a)]
        left.append(a[k])
        right.append(b[k])
    return (np.concatenate(left), np.concatenate(right)) if left else (at[:0], at[:0])


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least index that each index reaches over the pairs: labels pulled down and jumped."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def fingerprints(docs: DataFrame, n: int = 3, lanes: int = 1) -> DataFrame:
    """doc_id, fp binary of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([fingerprint(x, n, lanes) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp binary")


def _distinct(pieces: Iterable[np.ndarray]) -> np.ndarray:
    pieces = list(pieces)
    return np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, np.uint64)


def least_hashes(own: np.ndarray, count: int) -> np.ndarray:
    """The least of a set's hashes under each of `count` mixings; zeros for the empty set."""
    out = np.full(count, np.iinfo(np.uint64).max if len(own) else 0, np.uint64)
    salts = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(_GOLDEN)
    for at in range(0, len(own), 4096):
        x = own[at : at + 4096, None] ^ salts[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out = np.minimum(out, (x ^ (x >> np.uint64(31))).min(axis=0))
    return out


def set_fingerprints(rows: DataFrame, n: int, lanes: int) -> DataFrame:
    """row, fp, mark (digest of the set of shingles), size (of that set), mins (its least hashes) of rows (row, text)."""
    small_batches(rows.sparkSession)
    count = KEYS * (1 + DEEPER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, marks, sizes, mins = [], [], [], []
            for text in b.column(1).to_pylist():
                own = _distinct(shingle_hashes(text, n))
                fps.append(_majority([own], lanes))
                marks.append(hashlib.md5(own.tobytes()).digest())
                sizes.append(len(own))
                mins.append(least_hashes(own, count).view(np.int64))
            flat = pa.array(np.concatenate(mins) if mins else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(mins) + 1, dtype=np.int32) * count), flat)
            yield pa.record_batch([b.column(0), pa.array(fps, pa.binary()), pa.array(marks, pa.binary()), pa.array(sizes, pa.int64()), lists], names=["row", "fp", "mark", "size", "mins"])

    return rows.select("row", F.col("text").cast("string").alias("text")).mapInArrow(run, "row long, fp binary, mark binary, size long, mins array<long>")


def alike(x: np.ndarray, y: np.ndarray, least: tuple[int, int]) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least least[0] / least[1]."""
    over, under = least
    if under * min(len(x), len(y)) < over * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return under * both >= over * (len(x) + len(y) - both)


def alike_forest(sets: list[np.ndarray], least: tuple[int, int]) -> np.ndarray:
    """The least index that each set reaches over pairs that are `alike`; exact.

    Alike sets share one of their least hashes (as many as may be missing, and one more). Sets that
    share one are compared unless they hang together already: neighbours in size first, then the rest.
    """
    over, under = least
    cut = [x[: len(x) - -(-over * len(x) // under) + 1] for x in sets]
    held = np.repeat(np.arange(len(sets)), [len(c) for c in cut])
    root = np.arange(len(sets))
    if not len(held):
        return root
    size = np.array([len(x) for x in sets])
    hashes = np.concatenate(cut)
    order = np.lexsort((size[held], hashes))
    hashes, held = hashes[order], held[order]
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    ends = np.r_[starts[1:], len(hashes)]
    refuted = set()

    def tried(i: int, j: int) -> None:
        pair = (min(i, j), max(i, j))
        if root[i] == root[j] or pair in refuted:
            return
        if alike(sets[i], sets[j], least):
            low, high = sorted((root[i], root[j]))
            root[root == high] = low
        else:
            refuted.add(pair)

    for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
        own = held[s:e]
        if (root[own] == root[own[0]]).all():
            continue
        for i, j in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
            tried(i, j)
        for k, i in enumerate(own.tolist()):
            rest = own[k + 1 :]
            for j in rest[root[rest] != root[i]].tolist():
                tried(i, j)
    return root


def _alike_links(texts: DataFrame, n: int, least: tuple[int, int]) -> DataFrame:
    """(a, b): a spanning forest of the alike pairs in each group, from rows (grp, x, y, row, text) sorted by group."""

    def compare(rows: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
        root = alike_forest(held, least)
        some = np.flatnonzero(root != np.arange(len(root)))
        node = np.array(rows, np.int64)
        return pa.record_batch([pa.array(node[some]), pa.array(node[root[some]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, held = None, [], []
        for b in batches:
            for grp, x, y, row, text in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if (grp, x, y) != last:
                    if len(rows) > 1:
                        yield compare(rows, held)
                    last, rows, held = (grp, x, y), [], []
                rows.append(row)
                held.append(_distinct(shingle_hashes(text, n)))
        if len(rows) > 1:
            yield compare(rows, held)

    return texts.select("grp", "x", "y", "row", "text").mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, n: int, lanes: int, radius: int, least: tuple[int, int], cuts: Cuts) -> DataFrame:
    """Of row (a unique number), text: row, component_row (least row reachable over alike pairs).

    Candidates have a least hash in common, those whose fingerprints are within the radius make
    proposed groups, and inside a group the sets of shingles decide: a link joins texts whose Jaccard
    similarity is at least least[0] / least[1]. Equal sets always link and are compared once. A large
    group is cut into blocks, as crowded buckets are.
    """
    spark = docs.sparkSession
    marked = cuts.write(set_fingerprints(docs, n, lanes))
    classes = marked.groupBy("mark").agg(F.min("row").alias("node"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("mins").alias("mins"))
    classes = cuts.write(classes)
    some = classes.where("size > 0").select("node", "fp", "mins")

    def keys(rows: DataFrame, level: int) -> DataFrame:
        """A row for each of the level's least hashes."""
        own = F.explode(F.transform(F.slice("mins", 1 + level * KEYS, KEYS), lambda m, k: F.struct((F.lit(level * KEYS) + k).alias("tab"), m.alias("least"))))
        return rows.withColumn("m", own).select(F.xxhash64("key", "m.tab", "m.least").alias("key"), F.col("m.tab").cast("int").alias("via"), "node", "fp")

    def deeper(rows: DataFrame, level: int) -> DataFrame | None:
        if level > DEEPER:
            return None
        return keys(rows.select("key", "node").join(some.hint("merge"), "node"), level)

    small_batches(spark, 4096)
    first = keys(some.withColumn("key", F.lit(0).cast("long")), 0)
    proposed = components(cuts.write(links(first, radius, cuts, deeper)), cuts)
    grouped = cuts.write(classes.select("node", "size").join(proposed.hint("merge"), "node").select("node", "size", F.col("root").alias("grp")))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / GATHER_HASHES)).cast("int").alias("blocks")
    sizes = cuts.write(grouped.groupBy("grp").agg(blocks))  # written, so that a large group's rows can be split in the join
    wanted = cuts.write(grouped.join(sizes.hint("merge"), "grp").select(F.col("node").alias("row"), "grp", "blocks"))
    small_batches(spark)
    texts = among(docs.select("row", F.col("text").cast("string").alias("text")), wanted, "row")
    dealt = _in_blocks(texts, "row").select("grp", "x", "y", "row", "text").repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y")
    roots = components(cuts.write(_alike_links(dealt, n, least)), cuts)
    cuts.only(marked, classes, roots)
    of_class = classes.select("mark", "node").join(roots.hint("merge"), "node", "left").select("mark", F.coalesce("root", "node").alias("component_row"))
    return marked.select("row", "mark").join(of_class.hint("merge"), "mark").select("row", "component_row")


def _keyed(classes: DataFrame, masks: list[np.ndarray]) -> DataFrame:
    """A row per class and table: key, via (the table), node, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            bits = np.unpackbits(rows, axis=1, bitorder="little")
            keys = []
            for tab, mask in enumerate(masks):
                packed = np.zeros((b.num_rows, 8), np.uint8)
                some = np.packbits(bits[:, mask], axis=1, bitorder="little")
                packed[:, : some.shape[1]] = some
                keys.append(_in_table(packed.view(np.uint64).reshape(-1), np.uint64(tab)))
            at = np.repeat(np.arange(b.num_rows), len(masks))
            yield pa.record_batch([pa.array(np.stack(keys, axis=1).reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(len(masks), dtype=np.int32), b.num_rows)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], names=["key", "via", "node", "fp"])

    return classes.select("node", "fp").mapInArrow(run, "key long, via int, node long, fp binary")


def _in_table(key: np.ndarray, tab) -> np.ndarray:
    """Keys of one table, made unlike those of others; a chance meeting only adds a comparison."""
    x = key ^ (np.asarray(tab, np.uint64) + np.uint64(1)) * np.uint64(_GOLDEN)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _rekeyed(rows: DataFrame, masks: list[np.ndarray], radius: int) -> DataFrame:
    """Rows of crowded buckets under further keys: the places that their table's mask left, in radius + 1
    parts, of which two fingerprints within the radius agree on one at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            old, via = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            bits = np.unpackbits(np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1, bitorder="little")
            keys = np.zeros((b.num_rows, radius + 1), np.uint64)
            for tab in np.unique(via):
                here = np.flatnonzero(via == tab)
                left = np.setdiff1d(np.arange(bits.shape[1]), masks[tab])
                for part, places in enumerate(np.array_split(left, radius + 1)):
                    packed = np.zeros((len(here), -(-len(places) // 64) * 8), np.uint8)
                    some = np.packbits(bits[np.ix_(here, places)], axis=1, bitorder="little")
                    packed[:, : some.shape[1]] = some
                    key = _in_table(old[here], part)
                    for word in packed.view(np.uint64).T:
                        key = _in_table(key ^ word, part)
                    keys[here, part] = key
            at = pa.array(np.repeat(np.arange(b.num_rows), radius + 1))
            yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), b.column(1).take(at), b.column(2).take(at), b.column(3).take(at)], names=["key", "via", "node", "fp"])

    return rows.select("key", "via", "node", "fp").mapInArrow(run, "key long, via int, node long, fp binary")


def _in_blocks(rows: DataFrame, by: str) -> DataFrame:
    """Rows with x, y: each once for every pair of blocks that its own block (by hash) is part of."""
    own = F.pmod(F.xxhash64(by), F.col("blocks")).cast("int")
    placed = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("own", "other")


def links(keyed: DataFrame, radius: int, cuts: Cuts, deeper=None) -> DataFrame:
    """(a, b): a spanning forest of the links in each bucket, from rows (key, via, node, fp).

    deeper(rows, level) gives the rows of crowded buckets under further keys, None where there are none.
    """
    ready, level = [], 0
    while True:
        keyed = cuts.write(keyed)
        # written first, so that the plans don't hang on what is guessed of their sizes
        crowd = cuts.write(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
        if crowd.isEmpty():
            ready.append(keyed.withColumn("blocks", F.lit(1)))
            break
        placed = keyed.join(crowd.hint("merge"), "key", "left").fillna(1, ["blocks"])
        level += 1
        more = deeper(placed.where(F.col("blocks") > CROWD).drop("blocks"), level) if deeper else None
        ready.append(placed if more is None else placed.where(F.col("blocks") <= CROWD))
        if more is None:
            break
        keyed = more
    placed = ready[0].select("key", "blocks", "node", "fp")
    for x in ready[1:]:
        placed = placed.union(x.select("key", "blocks", "node", "fp"))
    dealt = _in_blocks(placed, "node").select("key", "x", "y", "node", "fp").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def compare(keys, xs, ys, nodes, fps) -> pa.RecordBatch:
        key, x, y = (np.concatenate(v) for v in (keys, xs, ys))
        node = np.concatenate(nodes)
        new = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        group = np.concatenate([[0], np.cumsum(new)])
        rows = np.frombuffer(b"".join(fps), np.uint8).reshape(len(node), -1)
        starts = np.flatnonzero(np.r_[True, new])
        sizes = np.diff(np.r_[starts, len(node)])
        small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 48), sizes))
        i, j = near_in_small_groups(rows[small], group[small], radius) if len(small) else (small, small)
        i, j = [small[i]], [small[j]]
        for s in np.flatnonzero(sizes > 48):
            a, b = near_in_group(rows[starts[s] : starts[s] + sizes[s]], radius)
            i.append(starts[s] + a)
            j.append(starts[s] + b)
        root = forest(np.concatenate(i), np.concatenate(j), len(node))
        some = np.flatnonzero(root != np.arange(len(node)))
        return pa.record_batch([pa.array(node[some]), pa.array(node[root[some]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [[] for _ in range(5)], 0, None
        for b in batches:
            cols = [b.column(k).to_numpy() for k in range(4)]
            fps = b.column(4).to_pylist()
            new = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            starts = np.flatnonzero(new) + 1
            if last is not None and last != tuple(c[0] for c in cols[:3]):
                starts = np.r_[0, starts]
            at = 0
            if size + b.num_rows > GATHER and len(starts):
                at = int(starts[-1])
                for k in range(4):
                    held[k].append(cols[k][:at])
                held[4].extend(fps[:at])
                if size + at:
                    yield compare(*held)
                held, size = [[] for _ in range(5)], 0
            for k in range(4):
                held[k].append(cols[k][at:])
            held[4].extend(fps[at:])
            size += b.num_rows - at
            last = tuple(c[-1] for c in cols[:3])
        if size:
            yield compare(*held)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 3, lanes: int = 1, radius: int = 3) -> DataFrame:
    """Of doc_id, text: doc_id, fp binary, component_id (least doc_id reachable over links).

    A link joins fingerprints that differ in `radius` bits at most; none is lost.
    """
    spark = docs.sparkSession
    cuts = Cuts(spark, "simhash")
    marked = cuts.write(fingerprints(docs, n, lanes))
    small_batches(spark, 4096)
    known = marked.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc_id"), "fp")
    classes = cuts.write(known.groupBy("fp").agg(F.min("doc_id").alias("node")).select("node", "fp"))
    masks = exact_masks(64 * lanes, radius, classes.count())
    found = cuts.write(links(_keyed(classes, masks), radius, cuts, lambda rows, level: _rekeyed(rows, masks, radius) if level == 1 else None))
    # a document with several texts links them all
    twice = known.join(classes, "fp").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    many = known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("a"))
    if not many.isEmpty():
        found = found.union(twice.join(many, "a").select("a", "b"))
    roots = components(found, cuts)
    placed = classes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    small_batches(spark)
    cuts.only(marked, classes, roots)
    back = F.when(F.col("component_id") != _NULL_ID, F.col("component_id"))
    return marked.join(placed, "fp").select("doc_id", "fp", back.alias("component_id"))


def hex_of(fp: str = "fp"):
    """A 64-bit fingerprint as 16 hexadecimal digits, most significant first."""
    return F.lower(F.concat(*[F.hex(F.substring(F.col(fp), k, 1)) for k in range(8, 0, -1)]))
