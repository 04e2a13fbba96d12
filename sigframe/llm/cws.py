"""Document fingerprints by consistent weighted sampling.

A text is the weighted set of its words (runs of other than ASCII white space, A-Z lower-cased),
weighted by how often each stands in it. For sample k and word x the hash of (x, k) gives
r, c ~ Gamma(2, 1) and b ~ U(0, 1); with t = floor(ln w / r + b) and
ln a = ln c - r (t - b + 1) the sample is the pair (x, t) of least a. Two texts agree on a sample
with probability sum min(w, v) / sum max(w, v), their generalised Jaccard similarity, so the share
of equal samples estimates it (standard error at most 0.5 / sqrt(SAMPLES)).

The gammas are made from the word's hash alone, nothing is kept per vocabulary, and a fingerprint
is SAMPLES 32-bit hashes of the pairs in hexadecimal. Documents are put next to each other by a
range partitioning of doc_id with one borrowed row per part. A doc_id (or the lack of one) with more
rows than a part holds has parts of its own, by the hash of the text, and its equal rows are counted
first; so nothing gathers in one task.

Cases: a null text counts as empty; the empty weighted set has the all-zero fingerprint and is like
itself with 1 and like others with 0; equal texts have equal fingerprints; rows with equal doc_id
are ordered by a hash of the text, then the text, and null doc_ids come last; a single row is its own
next; an empty table gives no rows; a text of any length is read whole, as one row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import Cuts, small_batches

SAMPLES = 128
#: Parameters of so many words are kept by a worker at once (SAMPLES x 12 bytes each).
KEEP_WORDS = 24_000
#: Rows of a part, and how many parts there are at most (they then hold more rows).
PART_ROWS, MOST_PARTS = 2_000, 1 << 17
#: Rows that one task writes for equal rows.
CHUNK = 4096
_GOLDEN = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _unit(x: np.ndarray, bits: int) -> np.ndarray:
    """Whole numbers below 2 ** bits as numbers in (0, 1)."""
    out = x.view(np.int32).astype(np.float32)
    out += np.float32(0.5)
    out *= np.float32(2.0**-bits)
    return out


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)


def _log_gamma(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """-ln of the product of two uniforms, each from 21 bits: Gamma(2, 1)."""
    u = _unit(low >> np.uint32(11), 21)
    u *= _unit(high >> np.uint32(11), 21)
    np.log(u, out=u)
    return np.negative(u, out=u)


class Sampler:
    """Fingerprints of texts; keeps the parameters of words seen lately."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        lanes = np.arange(2 * samples, dtype=np.uint64) * np.uint64(_GOLDEN)
        self.lanes = _mix(lanes + np.uint64(1))
        self.rows: dict[bytes, int] = {}
        self.reset()

    def reset(self) -> None:
        self.rows.clear()
        self.used = 0
        shape = (KEEP_WORDS, self.samples)
        self.r, self.b, self.once = (np.empty(shape, np.float32) for _ in range(3))
        self.hash = np.empty(KEEP_WORDS, np.uint64)

    def parameters(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, b and ln c of words' hashes, a row each."""
        low, high = _halves(_mix(hashes[:, None] ^ self.lanes[None, : self.samples]))
        r = _log_gamma(low, high)
        rest = (low & np.uint32(0x7FF)) << np.uint32(11)
        b = _unit(rest | (high & np.uint32(0x7FF)), 22)
        ln_c = _log_gamma(*_halves(_mix(hashes[:, None] ^ self.lanes[None, self.samples :])))
        return r, b, np.log(ln_c, out=ln_c)

    def learn(self, words: list[bytes]) -> None:
        """Makes the parameters of words that aren't kept; forgets all before it would overflow."""
        new = [w for w in words if w not in self.rows]
        if self.used + len(new) > KEEP_WORDS:
            self.rows.clear()
            self.used = 0
            new = words
        for at in range(0, len(new), 2048):
            some = new[at : at + 2048]
            hashes = np.array([xxhash.xxh64_intdigest(w, 7) for w in some], np.uint64)
            r, b, ln_c = self.parameters(hashes)
            rows = slice(self.used, self.used + len(some))
            self.r[rows], self.b[rows], self.hash[rows] = r, b, hashes
            self.once[rows] = ln_c - r * (1 - b)  # ln a at weight 1, where t = 0
            self.rows.update(zip(some, range(self.used, self.used + len(some)), strict=True))
            self.used += len(some)

    def _least(self, words: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ln a, the word's hash and t of the least sample in each lane."""
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        ln_a = self.once.take(rows, axis=0)
        many = np.flatnonzero(weights > 1)
        t = None
        if len(many):
            at = rows[many]
            r, b = self.r[at], self.b[at]
            t = np.floor(np.log(weights[many]).astype(np.float32)[:, None] / r + b)
            ln_a[many] -= r * t
        least = ln_a.argmin(axis=0)
        lanes = np.arange(self.samples)
        step = np.zeros(self.samples, np.int64)
        if t is not None:
            place = np.full(len(words), -1)
            place[many] = np.arange(len(many))
            here = place[least]
            step = np.where(here >= 0, t[np.maximum(here, 0), lanes], 0).astype(np.int64)
        return ln_a[least, lanes], self.hash[rows[least]], step

    def fingerprint(self, text: str) -> np.ndarray:
        """SAMPLES uint32; all zero for a text without words."""
        counts = Counter(text.encode("utf-8", "surrogatepass").lower().split())
        if not counts:
            return np.zeros(self.samples, np.uint32)
        words, weights = list(counts), np.fromiter(counts.values(), np.float64, len(counts))
        best = None
        for at in range(0, len(words), 8192):  # a very long text in pieces; the least of all is kept
            some = words[at : at + 8192]
            self.learn(some)
            got = self._least(some, weights[at : at + 8192])
            if best is None:
                best = got
            else:
                less = (got[0] < best[0]) | ((got[0] == best[0]) & (got[1] < best[1]))
                best = tuple(np.where(less, x, y) for x, y in zip(got, best, strict=True))
        made = (_mix(best[1] ^ (best[2].astype(np.uint64) * np.uint64(_GOLDEN))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return np.maximum(made, 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def to_hex(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def edited(text: str, other: str) -> str:
    """The last third of the code points, floored, replaced by the first as many of the other text."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def _above(cuts: list[int], value) -> F.Column:
    """How many of the descending cuts are above the value, in steps of 64."""
    if len(cuts) <= 64:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<long>"), lambda c: c > value))
    chunks = [cuts[k : k + 64] for k in range(0, len(cuts), 64)]
    coarse = _above([c[0] for c in chunks], value)
    inside = F.element_at(F.array(*[F.array(*[F.lit(c) for c in x]).cast("array<long>") for x in chunks]), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * 64 + F.size(F.filter(inside, lambda c: c > value)))


def _hash(text: str = "text") -> F.Column:
    """A hash of the text from 0 up."""
    return F.shiftrightunsigned(F.xxhash64(text), 1)


def in_descending_parts(docs: DataFrame, rows_per_part: int = PART_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """part, sub, borrowed, doc_id, text: whole parts in one partition, rows by descending doc_id and hash.

    After its own rows each part has the first row of the following part (of the first part after the
    last), borrowed. The driver gets quantiles of doc_id, the doc_ids with more rows than a part holds,
    and one row per part. Equal rows of such a doc_id come once; the second table has (doc_id, text, n)
    of those that come n > 1 times, None where there are none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.count()
    parts = min(MOST_PARTS, -(-total // rows_per_part))
    per = max(rows_per_part, -(-total // MOST_PARTS))
    cuts: set[int] = set()
    if parts > 1:
        got = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100_000)).first()[0]
        cuts = set(got or [])
    hot = {r["doc_id"]: r["n"] for r in rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > per).collect()}  # at most total / per
    again = None
    if hot:
        cuts |= {c for v in hot if v is not None for c in (v, min(v + 1, (1 << 63) - 1))}
        sizes = spark.createDataFrame([(v, -(-n // per)) for v, n in hot.items()], "hot long, subs long")
        marked = rows.join(F.broadcast(sizes), F.col("doc_id").eqNullSafe(F.col("hot")), "left")
        counted = Cuts(spark, "cws").write(marked.where("subs IS NOT NULL").groupBy("doc_id", "text", "subs").agg(F.count("*").alias("n")))
        again = counted.where("n > 1").select("doc_id", "text", "n")
        rows = marked.where("subs IS NULL").select("doc_id", "text", F.lit(1).cast("long").alias("subs")).union(counted.select("doc_id", "text", "subs"))
    else:
        rows = rows.withColumn("subs", F.lit(1).cast("long"))
    falling = sorted(cuts, reverse=True)
    part = F.when(F.col("doc_id").isNull(), len(falling) + 1).otherwise(_above(falling, F.col("doc_id"))).cast("int")
    sub = F.floor(_hash().cast("double") / F.lit(2.0**63) * F.col("subs"))
    placed = rows.select(part.alias("part"), F.least(sub, F.col("subs") - 1).cast("int").alias("sub"), "doc_id", "text", (-_hash()).alias("less"))
    heads = sorted((r["part"], r["sub"], r["x"]["doc_id"], r["x"]["less"]) for r in placed.groupBy("part", "sub").agg(F.max(F.struct("doc_id", "less")).alias("x")).collect())
    lent = spark.createDataFrame([(*heads[k], *heads[k - 1][:2]) for k in range(len(heads))], "part int, sub int, head long, head_less long, to int, to_sub int")
    first = placed.join(F.broadcast(lent), ["part", "sub"]).where("doc_id <=> head AND less = head_less").groupBy("to", "to_sub").agg(F.min(F.struct("text", "doc_id", "less")).alias("x"))
    own = placed.select("part", "sub", F.lit(False).alias("borrowed"), "doc_id", "text", "less")
    every = own.union(first.select(F.col("to").alias("part"), F.col("to_sub").alias("sub"), F.lit(True).alias("borrowed"), "x.doc_id", "x.text", "x.less"))
    dealt = every.repartition("part", "sub").sortWithinPartitions("part", "sub", "borrowed", F.col("doc_id").desc_nulls_last(), F.col("less").desc(), "text")
    return dealt.select("part", "sub", "borrowed", "doc_id", "text"), again


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_OUT_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _result(sampler: Sampler, doc_id: int | None, text: str, mark: np.ndarray, after: str, after_mark: np.ndarray) -> tuple:
    new = edited(text, after)
    new_mark = sampler.fingerprint(new)
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, to_hex(mark), to_hex(new_mark), likeness(mark, new_mark), likeness(mark, after_mark)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _OUT, strict=True)] if out else [pa.array([], f.type) for f in _OUT], schema=_OUT)


def fingerprint_with_edits(docs: DataFrame, samples: int = SAMPLES, rows_per_part: int = PART_ROWS) -> DataFrame:
    """Of doc_id, text: a row per document with its fingerprint, that of its edited text (see
    `edited`; the other text is the next document's in descending doc_id, after the last the
    first's), and the likeness of its fingerprint to the edited text's and to the next document's.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, before = Sampler(samples), None
        for b in batches:
            out = []
            for part, sub, borrowed, doc_id, text in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                mark = sampler.fingerprint(text)
                if before is not None and before[:2] == (part, sub):
                    out.append(_result(sampler, *before[2:], text, mark))
                before = None if borrowed else (part, sub, doc_id, text, mark)
            yield _batch(out)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for b in batches:
            marks = [(i, t, sampler.fingerprint(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            made = _batch([_result(sampler, i, t, m, t, m) for i, t, m in marks])
            yield pa.record_batch([*made.columns, b.column(2)], names=[*_OUT.names, "n"])

    dealt, again = in_descending_parts(docs, rows_per_part)
    out = dealt.mapInArrow(run, _OUT_SQL)
    if again is None:
        return out
    # of equal rows each but one is followed by its like; they are written out in chunks by many tasks
    once = again.mapInArrow(alone, f"{_OUT_SQL}, n long")
    chunks = once.withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long")))).repartition("doc_id", "fingerprint", "at")
    copies = chunks.withColumn("k", F.explode(F.sequence("at", F.least(F.col("at") + CHUNK - 1, F.col("n") - 1))))
    return out.union(copies.select(*_OUT.names))
