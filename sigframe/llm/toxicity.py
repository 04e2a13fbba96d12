"""Toxic spans and scores by a linear-chain conditional random field.

Labels are per document, so tokens are labelled first: in a bounded sample of labelled documents,
cues (whole forms, and beginnings and ends of forms) that stand in toxic documents and hardly
elsewhere are picked greedily, each time the one that explains the most toxic documents not yet
explained (a cue counts from its first, second or fourth token on, whichever separates best); the
tokens in toxic documents that have a picked cue are the toxic tokens. Of documents that share most word pairs one stands for all, with their commoner label, and a
cue must stand in so many toxic documents that chance and mislabelled ones don't explain it. The
field has two states and learns by Adam on its exact likelihood, whose gradient is the difference of
expected and labelled counts of cues and of pairs of neighbours: weights of the cues of forms and of
the transitions. A form is a lower-cased token without punctuation at its ends.

Scoring runs forward and backward over each whole text. With two states a message is one ratio and a
step is a Moebius map, so texts are cut into blocks whose maps are composed side by side, the blocks
of a text are chained, and the tokens of all blocks are filled in side by side: exact, and vectorised
for long texts too. A document's score is a logistic function of its greatest token log-odds and the
expected number of toxic tokens; offending offsets are runs of tokens with a marginal of 1/2 or more.

The sample is those of the `SAMPLE_DOCS` labelled documents of least hash that have `SAMPLE_CHARS`
characters or fewer; it alone reaches the driver. Cues are picked and the logistic function is fitted on
all of it, the field's weights on `FIT_DOCS` documents of either kind at most. Everything else covers all rows.

Cases: null and empty texts have no tokens and the score of such a document; without labels of both
kinds all documents score the share of toxic labels, or 0; labels that are null are left out, and of
several labels of a document a toxic one counts; of several rows of a labelled doc_id the least text is
learnt from; equal rows score equally; an empty table gives no rows; lang, source and doc_id are never inputs.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigframe.llm.common import small_batches

SAMPLE_DOCS, SAMPLE_CHARS, FIT_DOCS = 3_000, 20_000, 600
THRESHOLD = 0.3
#: Tokens of a block; forms whose emission a worker keeps.
BLOCK, KEEP_FORMS = 64, 300_000
#: Lengths of the beginnings and ends that are cues.
HEADS, TAILS = (3, 4, 5, 6, 7), (4, 5, 6)
#: Numbers of tokens in a document from which a cue can count.
LEVELS = (1, 2, 4)
#: Share of toxic documents among those that have a picked cue; how many cues may be expected by chance.
PRECISION, CHANCE = 0.93, 1.0
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_TOKEN = re.compile(r"\S+")


def form_of(token: str) -> str:
    return _EDGE.sub("", token.lower())


def cues_of(form: str) -> list[str]:
    """The form itself, its beginnings and its ends."""
    n = len(form)
    return [f"={form}", *[f"^{form[:k]}" for k in HEADS if k <= n], *[f"{form[-k:]}$" for k in TAILS if k <= n]] if form else []


@dataclass
class Model:
    """Weights; `base` is the score where nothing could be learnt."""

    cues: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    #: a00 is 1; potentials of O-T, T-O, T-T.
    moves: tuple[float, float, float] = (1.0, 1.0, 1.0)
    logistic: tuple[float, float, float] = (0.0, 0.0, 0.0)
    base: float | None = 0.0

    def emission(self, token: str) -> float:
        get = self.cues.get
        return sum([get(c, 0.0) for c in cues_of(form_of(token))], self.bias)


def _compose(maps: np.ndarray, backward: bool) -> np.ndarray:
    """Composition of each block's maps (2, 2, tokens, blocks), in reading order or against it."""
    steps = maps.shape[2]
    out = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, maps.shape[3])).copy()
    for k in range(steps - 1, -1, -1) if backward else range(steps):
        m = maps[:, :, k]
        out = np.stack([m[0, 0] * out[0] + m[0, 1] * out[1], m[1, 0] * out[0] + m[1, 1] * out[1]])
        if k % 8 == 0:
            out /= out.max(axis=(0, 1))
    return out


def messages(emission: np.ndarray, sizes: np.ndarray, moves: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with the token's own potential) and backward ratios of the toxic to the other state at each
    token of the texts laid end to end; a text begins as after a token that isn't toxic."""
    if not len(emission):
        return np.zeros(0), np.zeros(0)
    a01, a10, a11 = moves
    blocks = -(-sizes // BLOCK)
    first = np.r_[0, np.cumsum(blocks)][:-1]
    start = np.r_[0, np.cumsum(sizes)][:-1]
    place = np.repeat(first * BLOCK - start, sizes) + np.arange(len(emission))
    n = int(blocks.sum())
    x, there = np.ones(n * BLOCK), np.zeros(n * BLOCK, bool)
    x[place], there[place] = np.exp(np.clip(emission, -30, 30)), True
    x, there = x.reshape(n, BLOCK).T, there.reshape(n, BLOCK).T
    one, off = np.where(there, 1.0, 0.0), np.where(there, 0.0, 1.0)
    forward = np.array([[x * a11 * one + off, x * a01 * one], [a10 * one, np.ones_like(x)]])
    backward = np.array([[x * a11 * one + off, a10 * one], [x * a01 * one, np.ones_like(x)]])
    f_in, b_in = np.zeros(n), np.ones(n)
    f_map, b_map = _compose(forward, False), _compose(backward, True)
    order = np.argsort(-blocks, kind="stable")
    first, blocks = first[order], blocks[order]
    f, b = np.zeros(len(sizes)), np.ones(len(sizes))
    for k in range(int(blocks[0]) if len(blocks) else 0):
        live = int(np.searchsorted(-blocks, -k, "left"))
        at = first[:live] + k
        f_in[at] = f[:live]
        f[:live] = (f_map[0, 0, at] * f[:live] + f_map[0, 1, at]) / (f_map[1, 0, at] * f[:live] + f_map[1, 1, at])
        back = first[:live] + blocks[:live] - 1 - k
        b_in[back] = b[:live]
        b[:live] = (b_map[0, 0, back] * b[:live] + b_map[0, 1, back]) / (b_map[1, 0, back] * b[:live] + b_map[1, 1, back])
    ahead, behind = np.empty((BLOCK, n)), np.empty((BLOCK, n))
    f, b = f_in, b_in
    for k in range(BLOCK):
        f = (forward[0, 0, k] * f + forward[0, 1, k]) / (forward[1, 0, k] * f + forward[1, 1, k])
        ahead[k] = f
    for k in range(BLOCK - 1, -1, -1):
        behind[k] = b
        b = (backward[0, 0, k] * b + backward[0, 1, k]) / (backward[1, 0, k] * b + backward[1, 1, k])
    return ahead.T.reshape(-1)[place], behind.T.reshape(-1)[place]


def log_odds(emission: np.ndarray, sizes: np.ndarray, moves: tuple[float, float, float]) -> np.ndarray:
    """Marginal log-odds of the toxic state at each token of the texts laid end to end."""
    ahead, behind = messages(emission, sizes, moves)
    return np.log(np.maximum(ahead * behind, 1e-300))


def expected_counts(emission: np.ndarray, sizes: np.ndarray, moves: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """The probability of the toxic state at each token; the expected numbers of pairs O-T, T-O and T-T."""
    ahead, behind = messages(emission, sizes, moves)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    before = np.r_[0.0, ahead][:-1]
    before[first] = 0.0
    here = np.exp(np.clip(emission, -30, 30)) * behind
    weights = np.array([np.ones_like(here), moves[0] * here, moves[1] * before, moves[2] * before * here])
    weights /= weights.sum(axis=0)
    return weights[1] + weights[3], weights[1:].sum(axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def families(docs: list[np.ndarray], bands: int = 6) -> list[int]:
    """Of documents as word numbers: a number for each, equal for those that share most word pairs
    (min-hash bands)."""
    parent = list(range(len(docs)))

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    salts = _mix(np.arange(1, 2 * bands + 1, dtype=np.uint64))
    seen: dict[tuple, int] = {}
    for k, words in enumerate(docs):
        w = words.astype(np.uint64)
        pairs = _mix((w[:-1] << np.uint64(32)) | w[1:]) if len(w) > 1 else _mix(w)
        if len(pairs):
            low = [int(_mix(np.unique(pairs) ^ s).min()) for s in salts]
            for band in range(bands):
                other = top(seen.setdefault((band, low[2 * band], low[2 * band + 1]), k))
                parent[top(k)] = other
    return [top(k) for k in range(len(docs))]


def toxic_cues(doc: np.ndarray, cue: np.ndarray, count: np.ndarray, toxic: np.ndarray, lengths: np.ndarray, precision: float = PRECISION) -> list[tuple[int, int]]:
    """(cue, level) pairs that explain the toxic documents, picked greedily; of equally good ones the longest.

    doc, cue, count: how many tokens of a document have a cue; lengths: those of the cues.
    """
    size = len(lengths)
    share = max(1, int(toxic.sum())) / (len(toxic) + 1)
    # so many toxic documents that among the cues as common as that not one would be there by chance
    common = np.bincount(np.bincount(cue, minlength=size))
    above = common[::-1].cumsum()[::-1]
    least = next((n for n in range(3, len(above)) if above[n] * share**n < CHANCE), len(above))
    docs, items, cost = [], [], []
    for k, level in enumerate(LEVELS):
        there = count >= level
        bad = np.bincount(cue[there & toxic[doc]], minlength=size)
        good = np.bincount(cue[there & ~toxic[doc]], minlength=size)
        fit = (bad >= least) & (bad >= precision * (bad + good))
        some = there & toxic[doc] & fit[cue]
        docs.append(doc[some])
        items.append(cue[some] + k * size)
        cost.append(good)
    docs, items, cost = np.concatenate(docs), np.concatenate(items), np.concatenate(cost)
    names, items = np.unique(items, return_inverse=True)
    rank = cost[names] - lengths[names % size] / 100
    left, picked = np.ones(len(toxic), bool), []
    while len(names):
        gain = np.bincount(items[left[docs]], minlength=len(names))
        best = int(np.argmax(np.where(gain > 1, gain - rank, -np.inf)))
        if gain[best] < 2:
            break
        picked.append((int(names[best] % size), LEVELS[int(names[best] // size)]))
        left[docs[items == best]] = False
    return picked


def train(texts: list[str], toxic: list[bool], rounds: int = 50, most_of_each: int = FIT_DOCS) -> Model:
    """A model from labelled texts."""
    if not any(toxic) or all(toxic):
        return Model(base=sum(toxic) / len(toxic) if toxic else 0.0)
    number: dict[str, int] = {}
    seqs = [np.array([number.setdefault(form_of(x), len(number)) for x in t.split()], np.int32) for t in texts]
    words = list(number)
    del number
    share: dict[int, list[int]] = {}
    for k, f in enumerate(families(seqs)):
        share.setdefault(f, []).append(k)
    heads = [group[0] for group in share.values()]
    toxic = [2 * sum(toxic[k] for k in group) >= len(group) for group in share.values()]
    texts, seqs = [texts[k] for k in heads], [seqs[k] for k in heads]
    hashes, lengths = array("Q"), array("i")
    for w in words:
        own = cues_of(w)
        lengths.append(len(own))
        hashes.extend(map(xxhash.xxh64_intdigest, own))
    names, first, cue = np.unique(np.frombuffer(hashes, np.uint64), return_index=True, return_inverse=True)
    cue, per_word = cue.astype(np.int32), np.frombuffer(lengths, np.int32)
    at_word = np.cumsum(per_word) - per_word
    size_of = np.fromiter((len(c) for w in words for c in cues_of(w)), np.int32, len(cue))[first]
    del names, first, hashes
    docs_, cues_, counts_ = [], [], []
    for k, s in enumerate(seqs):  # how many tokens of each document have each cue
        word, times = np.unique(s, return_counts=True)
        many = per_word[word]
        spot = np.repeat(at_word[word] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        here, back = np.unique(cue[spot], return_inverse=True)
        docs_.append(np.full(len(here), k, np.int32))
        cues_.append(here)
        counts_.append(np.bincount(back, np.repeat(times, many), len(here)).astype(np.int32))
    doc, cue_of, count = np.concatenate(docs_), np.concatenate(cues_), np.concatenate(counts_)
    del docs_, cues_, counts_
    is_toxic = np.array(toxic)
    picked = toxic_cues(doc, cue_of, count, is_toxic, size_of)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), per_word)
    marked: dict[int, np.ndarray] = {}
    for c, level in picked:
        has = np.zeros(len(words), bool)
        has[owner[cue == c]] = True
        for k in doc[(cue_of == c) & (count >= level) & is_toxic[doc]].tolist():
            marked[k] = has[seqs[k]] | marked.get(k, False)
    rows = [*sorted(marked)[:most_of_each], *[k for k, t in enumerate(toxic) if not t and len(seqs[k])][:most_of_each]]
    known = np.isin(doc, rows)
    keep = np.bincount(cue_of[known], minlength=len(size_of)) >= 3
    keep[[c for c, _ in picked]] = True
    new = np.cumsum(keep) - 1
    held, at = keep[cue], 0
    vocabulary = [""] * int(keep.sum())
    for w, n in zip(words, per_word.tolist(), strict=True):
        if held[at : at + n].any():
            for c, k in zip(cues_of(w), cue[at : at + n].tolist(), strict=True):
                if keep[k]:
                    vocabulary[new[k]] = c
        at += n
    owner, cue = owner[held], new[cue[held]]
    seq = np.concatenate([seqs[k] for k in rows])
    sizes = np.array([len(seqs[k]) for k in rows], np.int64)
    y = np.concatenate([marked[k] if k in marked else np.zeros(len(seqs[k])) for k in rows]).astype(float)
    first = np.r_[0, np.cumsum(sizes)][:-1]
    before = np.r_[0.0, y][:-1]
    before[first] = 0.0
    labelled = np.array([((1 - before) * y).sum(), (before * (1 - y)).sum(), (before * y).sum()])
    del doc, cue_of, count, known, seqs
    weights = [np.zeros(len(vocabulary)), np.array([-4.0]), np.zeros(3)]
    moment = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, rounds + 1):
        own, bias, moves = weights
        emission = (np.bincount(owner, own[cue], len(words)) + bias[0])[seq]
        p, pairs = expected_counts(emission, sizes, tuple(np.exp(moves)))
        miss = p - y
        by_word = np.bincount(seq, miss, len(words))
        gradient = [
            np.bincount(cue, by_word[owner], len(vocabulary)) + 0.1 * own,
            np.array([miss.sum()]),
            pairs - labelled + 1.0 * moves,
        ]
        for k, g in enumerate(gradient):
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            weights[k] = weights[k] - 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    own, bias, moves = weights
    model = Model({c: float(w) for c, w in zip(vocabulary, own, strict=True) if abs(w) > 1e-3}, float(bias[0]), tuple(float(x) for x in np.exp(moves)), base=None)
    scorer = Scorer(model)
    features = np.array([f[:2] for at in range(0, len(texts), 200) for f in scorer.features(texts[at : at + 200])])
    truth = np.array(toxic, float)
    w = np.zeros(3)
    x = np.c_[np.ones(len(truth)), features]
    for _ in range(50):  # Newton steps on the penalised likelihood
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        w = w - np.linalg.solve(h, x.T @ (p - truth) + 0.05 * w)
    model.logistic = tuple(float(v) for v in w)
    return model


class Scorer:
    """Scores texts; keeps the emissions of tokens seen lately, in two generations."""

    def __init__(self, model: Model):
        self.model = model
        self.kept: dict[str, float] = {}
        self.older: dict[str, float] = {}

    def _emissions(self, tokens: list[str]) -> list[float]:
        kept, older, made = self.kept, self.older, self.model.emission
        out = list(map(kept.get, tokens))
        for k, e in enumerate(out):
            if e is None:
                t = tokens[k]
                e = kept.get(t)
                if e is None:
                    e = older.get(t)
                    kept[t] = e = made(t) if e is None else e
                out[k] = e
        return out

    def features(self, texts: list[str]) -> list[tuple[float, float, np.ndarray]]:
        """Per text: its greatest log-odds (from -20 to 20), ln(1 + expected toxic tokens), toxic token numbers."""
        if len(self.kept) > KEEP_FORMS:
            self.older, self.kept = self.kept, {}
        split = [t.split() for t in texts]
        sizes = np.array([len(s) for s in split], np.int64)
        flat = np.array([e for s in split for e in self._emissions(s)], float)
        odds = np.clip(log_odds(flat, sizes, self.model.moves), -20, 20)
        p = _sigmoid(odds)
        out, at = [], 0
        for n in sizes.tolist():
            o = odds[at : at + n]
            out.append((float(o.max()), float(np.log1p(p[at : at + n].sum())), np.flatnonzero(o >= 0)) if n else (-20.0, 0.0, np.zeros(0, np.int64)))
            at += n
        return out

    def score(self, texts: list[str]) -> list[tuple[float, float, list[dict]]]:
        """Per text: score, expected toxic tokens, offending spans."""
        out = []
        c = self.model.logistic
        for text, (top, many, tokens) in zip(texts, self.features(texts), strict=True):
            s = self.model.base if self.model.base is not None else float(_sigmoid(np.array(c[0] + c[1] * top + c[2] * many)))
            spans: list[dict] = []
            if len(tokens):
                wanted, last = set(tokens.tolist()), -2
                for k, m in enumerate(_TOKEN.finditer(text)):
                    if k in wanted:
                        if last == k - 1:
                            spans[-1]["end"] = m.end()
                        else:
                            spans.append({"start": m.start(), "end": m.end()})
                        last = k
            out.append((s, float(np.expm1(many)), spans))
        return out


def held_out(doc_id: str = "doc_id"):
    return F.coalesce((F.crc32(F.col(doc_id).cast("string")) % 4) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic) outside the held-out quarter."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    known = known.groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = known.orderBy(F.xxhash64(F.lit(3), "label_id"), "label_id").limit(sample_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("label_id")).where(F.length("text") <= sample_chars)
    got = rows.groupBy("label_id", "toxic").agg(F.min("text").alias("text")).collect()  # a row per label at most
    got.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["label_id"])), r["text"]))
    return train([r["text"] for r in got], [r["toxic"] == 1 for r in got])


def score_documents(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score double, predicted int, toxic_tokens double (expected) and
    toxic_spans array<struct<start:int,end:int>>, code-point offsets."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    made = ("score", "predicted", "toxic_tokens", "toxic_spans")
    keep = [c for c in docs.columns if c not in made]
    at = keep.index(text)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            got = scorer.score([x or "" for x in b.column(at).to_pylist()])
            scores = [g[0] for g in got]
            yield pa.record_batch([*b.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.list_(span))], names=[*keep, *made])

    out = docs.select(*keep)
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("toxic_tokens", T.DoubleType()), T.StructField("toxic_spans", spans)]
    return out.mapInArrow(run, T.StructType([*out.schema.fields, *fields]))
