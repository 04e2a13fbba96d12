"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives Viterbi.

The automaton reads a text once. At each position it follows the output links of its state, that
is all pieces that end there, and relaxes the best score up to that position. Characters without a
piece fall back to their UTF-8 bytes, at the least score less 10, as in unigram models.

A piece's score is its log probability under Zipf's law over the vocabulary's order,
-ln(rank + 1) - ln(H): merge models store ranks, not probabilities. `scores="file"` takes the
file's own. Ties go to the longer last piece.

No piece has the space mark after another character, so the best path of a text is that of its
parts cut before each run of spaces; each worker keeps the paths of recent parts. New parts of a
batch step through the automaton together, position by position, in numpy; parts that are long or
hold characters beyond Latin-1 go one by one.

Cases: a null text counts as empty and gives no pieces; the mark U+2581 in a text is written as
bytes, so that decoding is exact; very long parts are encoded without being kept; equal rows give
equal rows; other columns are carried along or ignored as the caller selects.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sigframe.llm.common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Parts longer than this aren't kept; so many are kept in each of two generations.
KEEP_CHARS, KEEP_PARTS = 40, 300_000
_PART = re.compile(" *[^ ]+| +")


def load_pieces(path: str = MODEL, scores: str = "zipf") -> dict:
    """The vocabulary as plain lists, read on the driver and sent to the executors (about 1 MB)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    text = [model.id_to_piece(i) for i in range(size)]
    plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    by_byte = {int(text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
    if scores == "file":
        score = [model.get_score(i) for i in plain]
    else:
        norm = math.log(sum(1 / (r + 1) for r in range(len(plain))))
        score = [-math.log(r + 1) - norm for r in range(len(plain))]
    return {"text": text, "ids": plain, "scores": score, "bytes": [by_byte[b] for b in range(256)]}


class PieceAutomaton:
    """States of the automaton are numbers; the goto function is a dict per state."""

    def __init__(self, vocabulary: dict):
        self.text = vocabulary["text"]
        self.byte_ids = vocabulary["bytes"]
        self.byte_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.go: list[dict[str, int]] = [{}]
        self.length, self.piece, self.score = [0], [-1], [0.0]
        for i, s in zip(vocabulary["ids"], vocabulary["scores"], strict=True):
            at = 0
            for ch in self.text[i]:
                nxt = self.go[at].get(ch)
                if nxt is None:
                    nxt = self.go[at][ch] = len(self.go)
                    self.go.append({})
                    self.length.append(self.length[at] + 1)
                    self.piece.append(-1)
                    self.score.append(0.0)
                at = nxt
            if self.piece[at] < 0 or s > self.score[at]:
                self.piece[at], self.score[at] = i, s
        self.fail, self.out = [0] * len(self.go), [0] * len(self.go)
        queue = deque(self.go[0].values())
        while queue:
            at = queue.popleft()
            for ch, nxt in self.go[at].items():
                back = self.fail[at]
                while back and ch not in self.go[back]:
                    back = self.fail[back]
                self.fail[nxt] = self.go[back].get(ch, 0)
                queue.append(nxt)
            self.out[at] = self.fail[at] if self.piece[self.fail[at]] >= 0 else self.out[self.fail[at]]
        #: For each state, the pieces that end there, longest first: (length, score, id).
        self.ends: list[tuple] = [()] * len(self.go)
        for at in range(1, len(self.go)):
            v, got = (at if self.piece[at] >= 0 else self.out[at]), []
            while v:
                got.append((self.length[v], self.score[v], self.piece[v]))
                v = self.out[v]
            self.ends[at] = tuple(got)
        self.unknown = min(vocabulary["scores"], default=0.0) - 10
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._tables()

    def _tables(self) -> None:
        """The same automaton as arrays, its goto function complete over Latin-1; column 32 is the mark."""
        n = len(self.go)
        self.step = np.zeros((n, 256), np.int32)
        order, at = [0], 0
        while at < len(order):
            state = order[at]
            at += 1
            if state:
                self.step[state] = self.step[self.fail[state]]
            for ch, nxt in self.go[state].items():
                code = 32 if ch == MARK else ord(ch) if ch != " " else 256
                if code < 256:
                    self.step[state, code] = nxt
                order.append(nxt)
        self.a_length, self.a_piece, self.a_score = np.array(self.length, np.int64), np.array(self.piece, np.int32), np.array(self.score)
        self.a_out = np.array(self.out, np.int32)
        self.a_first = np.where(self.a_piece >= 0, np.arange(n, dtype=np.int32), self.a_out)
        self.a_first[0] = 0
        #: What a character without a piece becomes; -1: more than one byte.
        self.a_byte = np.array([self.byte_ids[c] if c < 128 else -1 for c in range(256)], np.int32)

    def _together(self, parts: list[str], raw: list[bytes]) -> None:
        """Keeps the paths of `parts`, whose Latin-1 bytes are `raw`, after one pass over all at once."""
        n = len(raw)
        size_of = np.fromiter(map(len, raw), np.int64, n)
        order = np.argsort(-size_of, kind="stable")
        starts = (np.cumsum(size_of) - size_of)[order]
        flat, sizes = np.frombuffer(b"".join(raw), np.uint8), size_of[order]
        longest = int(sizes[0])
        active_at = np.searchsorted(-sizes, -np.arange(longest), "left").tolist()  # those longer than t
        best = np.zeros((longest + 1, n))
        via_size = np.ones((longest, n), np.int8)
        via_id = np.empty((longest, n), np.int32)
        state, lanes = np.zeros(n, np.int64), np.arange(n)
        step, flat_best = self.step.reshape(-1), best.reshape(-1)
        for t, active in enumerate(active_at):
            codes = flat[starts[:active] + t]
            now = step[(state[:active] << 8) + codes]
            state[:active] = now
            top, size, piece = best[t, :active] + self.unknown, via_size[t, :active], self.a_byte[codes]
            at, lane = self.a_first[now], lanes[:active]
            while True:
                some = np.flatnonzero(at)
                if not len(some):
                    break
                if len(some) < len(at):
                    lane, at = lane[some], at[some]
                length = self.a_length[at]
                s = flat_best[(t + 1 - length) * n + lane] + self.a_score[at]
                better = np.flatnonzero(s > top[lane])
                to, via = lane[better], at[better]
                top[to], size[to], piece[to] = s[better], length[better], self.a_piece[via]
                at = self.a_out[at]
            best[t + 1, :active], via_id[t, :active] = top, piece
        left, steps = sizes.copy(), []
        while active := int(np.count_nonzero(left)):
            live = lanes[:active] if active == n else np.flatnonzero(left)
            end = left[live] - 1
            row = np.full(n, -2, np.int32)
            row[live] = via_id[end, live]
            steps.append(row)
            left[live] -= via_size[end, live]
        path = np.array(steps[::-1]).T
        there = path != -2
        ends = np.cumsum(there.sum(axis=1) * 4).tolist()
        ids = path[there].tobytes()
        odd = set(np.flatnonzero((path == -1).any(axis=1)).tolist())
        at = 0
        for k, (i, end) in enumerate(zip(order.tolist(), ends, strict=True)):
            self.kept[parts[i]] = self._part(parts[i]) if k in odd else ids[at:end]
            at = end

    def viterbi(self, part: str) -> list[int]:
        """Ids of the best path. `part` has the mark for spaces; a mark of its own is \\x00 + mark."""
        go, fail, ends, unknown = self.go, self.fail, self.ends, self.unknown
        best, back, at = [0.0], [None], 0
        for n, ch in enumerate(part):
            while at and ch not in go[at]:
                at = fail[at]
            at = go[at].get(ch, 0)
            top, via, single = -math.inf, None, False
            for found in ends[at]:
                if (s := best[n + 1 - found[0]] + found[1]) > top:
                    top, via = s, found
                single = found[0] == 1
            if not single and (s := best[n] + unknown) > top:
                top, via = s, None
            best.append(top)
            back.append(via)
        ids, n = [], len(part)
        while n:
            if via := back[n]:
                ids.append(via[2])
                n -= via[0]
            else:
                ids.extend(self.byte_ids[b] for b in reversed(part[n - 1].encode()))
                n -= 1
        ids.reverse()
        return ids

    def _part(self, part: str) -> bytes:
        ids: list[int] = []
        for k, x in enumerate(part.split(MARK)):
            if k:
                ids.extend(self.byte_ids[b] for b in MARK.encode())
            if x:
                ids.extend(self.viterbi(x.replace(" ", MARK)))
        return np.array(ids, np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, with a space put before it as the model does; of an empty text, none."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """`encode` of each text; parts that are new to this worker go through the automaton together."""
        split = [_PART.findall(f" {x}") if x else [] for x in texts]
        if len(self.kept) > KEEP_PARTS:
            self.older, self.kept = self.kept, {}
        kept, older = self.kept, self.older
        found = [list(map(kept.get, parts)) for parts in split]
        new = {p for parts, ids in zip(split, found, strict=True) for p, x in zip(parts, ids, strict=True) if x is None}
        plain, raw = [], []
        for p in new:
            if (x := older.get(p)) is not None:
                kept[p] = x
            elif len(p) <= KEEP_CHARS and (x := p.encode("latin-1", "ignore")) and len(x) == len(p):
                raw.append(x)
                plain.append(p)
            else:
                kept[p] = self._part(p)
        for at in range(0, len(plain), 20_000):
            self._together(plain[at : at + 20_000], raw[at : at + 20_000])
        out = [np.frombuffer(b"".join([kept[p] if x is None else x for p, x in zip(parts, ids, strict=True)]), np.int32) for parts, ids in zip(split, found, strict=True)]
        for p in [p for p in new if len(p) > KEEP_CHARS]:
            del kept[p]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text that was encoded."""
        if not len(ids):
            return ""
        table = self.as_bytes
        return b"".join([table[i] for i in ids]).decode()[1:]

    @property
    def as_bytes(self) -> list[bytes]:
        if not hasattr(self, "_as_bytes"):
            self._as_bytes = [self.byte_of.get(i, x.replace(MARK, " ").encode()) for i, x in enumerate(self.text)]
        return self._as_bytes


_LOADED: dict[str, PieceAutomaton] = {}


def _automaton(shared) -> PieceAutomaton:
    key, vocabulary = shared.value
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceAutomaton(vocabulary)
    return _LOADED[key]


def encode_texts(df: DataFrame, text: str = "text", path: str = MODEL, scores: str = "zipf") -> DataFrame:
    """`df` with piece_ids array<int>, n_pieces int and exact boolean: decoding gave the text back.

    Columns of those names in `df` are replaced.
    """
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((f"{path}|{scores}", load_pieces(path, scores)))
    keep = [c for c in df.columns if c not in ("piece_ids", "n_pieces", "exact")]
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(shared)
        for b in batches:
            texts = [x or "" for x in b.column(at).to_pylist()]
            ids = auto.encode_all(texts)
            sizes = np.array([len(x) for x in ids], np.int32)
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            exact = [auto.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
            yield pa.record_batch([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sizes), pa.array(exact, pa.bool_())], names=[*keep, "piece_ids", "n_pieces", "exact"])

    out = df.select(*keep)
    made = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.IntegerType()), T.StructField("exact", T.BooleanType())]
    return out.mapInArrow(run, T.StructType([*out.schema.fields, *made]))


def decode_pieces(df: DataFrame, ids: str = "piece_ids", path: str = MODEL) -> DataFrame:
    """`df` with decoded string, the text of the ids (null: empty)."""
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((f"{path}|zipf", load_pieces(path)))
    keep = [c for c in df.columns if c != "decoded"]
    at = keep.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(shared)
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array([auto.decode(x or []) for x in b.column(at).to_pylist()], pa.string())], names=[*keep, "decoded"])

    out = df.select(*keep)
    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField("decoded", T.StringType())]))
