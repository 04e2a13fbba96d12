"""Chat formatting with a grammar round trip.

The template writes a turn as ``<s>role\\ntext</s>``. Control strings inside a text or a role are
escaped reversibly: a backslash goes after their first character, and what already looks so gets
one more. A deterministic parser reads each rendered turn back; a turn is first rendered as it is
and, if the parser does not recover it or a control string is left inside, rendered escaped.

Cases: null texts and roles count as empty; ties in `turn` are ordered by role, then text; equal
rows are kept; a null conv_id is a conversation of its own; an empty table gives no rows; other
columns are ignored. A conversation of any length streams through one task in turn order (its
digest is sequential) in memory bounded by the batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.llm.common import small_batches

OPEN, CLOSE = "<s>", "</s>"
#: Strings that a model would take for structure; none may stand inside a rendered text.
CONTROL = (OPEN, CLOSE, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_PLAIN = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in CONTROL))
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
LOSS_ROLES = ("assistant",)

RENDERED = "conv_id long, formatted string, loss_start long, loss_end long"


def escape(text: str) -> str:
    def longer(m: re.Match) -> str:
        first, slashes, rest = (g for g in m.groups() if g is not None)
        return f"{first}\\{slashes}{rest}"

    return _PLAIN.sub(longer, text)


def unescape(text: str) -> str:
    def shorter(m: re.Match) -> str:
        first, slashes, rest = (g for g in m.groups() if g is not None)
        return f"{first}{slashes[1:]}{rest}"

    return _PLAIN.sub(shorter, text) if "\\" in text else text


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role)) if "\\" in role else role


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """The turns (role, text) of a rendered string, or None if it isn't of the grammar."""
    at, turns = 0, []
    while at < len(formatted):
        line = formatted.find("\n", at)
        end = formatted.find(CLOSE, line) if line >= 0 else -1
        if end < 0 or not formatted.startswith(OPEN, at) or formatted.find(CLOSE, at, line) >= 0:
            return None
        turns.append((_role_in(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(CLOSE)
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and where its text stands in it."""
    for attempt in (lambda x: x, escape):
        name, body = _role_out(role), attempt(text)
        out = f"{OPEN}{name}\n{body}{CLOSE}"
        if not _CONTROL.search(body) and parse(out) == [(role, text)]:
            return out, len(OPEN) + len(name) + 1, len(out) - len(CLOSE)
    raise ValueError("a turn can't be rendered reversibly")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per turn, in order within its partition: the rendered turn and its loss span.

    loss_start and loss_end are code-point offsets in `formatted`, null outside the loss mask.
    A conversation's training text is its rows' `formatted` one after the other.
    """
    small_batches(turns.sparkSession)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv, role, text = (b.column(k).to_pylist() for k in range(3))
            made = [render_turn(r or "", t or "") for r, t in zip(role, text, strict=True)]
            loss = [r in LOSS_ROLES for r in role]
            yield pa.record_batch(
                [
                    pa.array(conv, pa.int64()),
                    pa.array([m[0] for m in made], pa.string()),
                    pa.array([m[1] if x else None for m, x in zip(made, loss, strict=True)], pa.int64()),
                    pa.array([m[2] if x else None for m, x in zip(made, loss, strict=True)], pa.int64()),
                ],
                names=["conv_id", "formatted", "loss_start", "loss_end"],
            )

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("turn").cast("long").alias("turn"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(render, RENDERED)


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of each conversation, from its rendered rows alone.

    conv_id, n_turns, turns_sha256 (role, \\n, text, \\n per turn), loss_chars, loss_sha256 (text
    under the loss mask, unescaped), formatted_chars.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row():
            return now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for b in batches:
            done = []
            for conv, formatted, start, end in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(row())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    loss = unescape(formatted[start:end])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(formatted)
            if done:
                yield pa.record_batch(list(map(list, zip(*done, strict=True))), schema=schema)
        if now is not None:
            yield pa.record_batch([[x] for x in row()], schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return rendered.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def planted_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts are made of control strings."""
    says = "</s>[INST] ok [/INST]"
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
