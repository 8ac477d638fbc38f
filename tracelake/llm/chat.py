r"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, with all preceding turns as
context and only that reply trainable.

Template: a turn is `### ROLE: TEXT</turn>` and a line feed. In roles and texts a backslash goes before each `\`, `#` and `<`
(in roles before `:` too), so no control string can arise from content, and taking the backslashes away gives the content back.

Defined results: null text or role counts as empty; turns are ordered by turn (null first), ties by role, then text; repeated
rows are repeated turns. Turns after the last assistant turn, or conversations without one, give one more example with
nothing trainable, so no turn is lost. A null conv_id is a conversation like any other. Other columns are ignored.
A task holds one conversation's turns and one example at a time, so memory is bounded by the longest conversation, not by the table
nor by the sum of its examples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_TEXT = re.compile(r"[\\#<]")
_ROLE = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.S)
EXAMPLES = "conv_id long, example int, n_turns int, formatted string, loss_start int, loss_end int"
ROWS_PER_BATCH = 256


def escape(text: str) -> str:
    return _TEXT.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where in it its text starts and ends."""
    head = f"### {_ROLE.sub(r'\\\g<0>', role)}: "
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted example."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _grouped(batches: Iterator[pa.RecordBatch], *names: str):
    """Runs of rows with equal conv_id, in a sorted partition."""
    key, rows, begun = None, [], False
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names)):
            if begun and row[0] != key:
                yield key, rows
                rows = []
            key, begun = row[0], True
            rows.append(row[1:])
    if begun:
        yield key, rows


def expand(conversations: DataFrame) -> DataFrame:
    """One row per example, in order within each conversation: formatted text and the [loss_start, loss_end) code points of its target (null: none)."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for conv, turns in _grouped(batches, "conv_id", "role", "text"):
            prefix, n, open_turns = "", 0, 0
            for i, (role, text) in enumerate(turns, 1):
                turn, start, end = format_turn(role, text)
                open_turns += 1
                if role == "assistant":
                    out.append((conv, n, i, prefix + turn, len(prefix) + start, len(prefix) + end))
                    size += len(prefix) + len(turn)
                    n, open_turns = n + 1, 0
                prefix += turn
                if len(out) >= ROWS_PER_BATCH or size > 4 << 20:
                    yield _examples(out)
                    out, size = [], 0
            if open_turns:
                out.append((conv, n, len(turns), prefix, None, None))
        if out:
            yield _examples(out)

    return c.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text").mapInArrow(run, EXAMPLES)


def _examples(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
    names = ["conv_id", "example", "n_turns", "formatted", "loss_start", "loss_end"]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)


def read_back(examples: DataFrame) -> DataFrame:
    """Digests per conversation, all parsed from the examples; these must stay in the order and partitions that `expand` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, last, loss, chars, total = None, None, None, 0, 0

        def close() -> None:
            turns = parse(last)
            whole = "".join(f"{role}\n{text}\n" for role, text in turns)
            out.append((key, len(turns), _hex(whole), chars, loss.hexdigest(), total))

        for batch in batches:
            for i in range(batch.num_rows):
                conv, text, a, b = (batch.column(c)[i].as_py() for c in ("conv_id", "formatted", "loss_start", "loss_end"))
                if last is None or conv != key:
                    if last is not None:
                        close()
                    key, loss, chars, total = conv, hashlib.sha256(), 0, 0
                last = text
                total += len(text)
                if a is not None:
                    own = unescape(text[a:b])
                    chars += len(own)
                    loss.update(own.encode("utf-8", "surrogatepass"))
            if out:
                yield _digests(out)
                out.clear()
        if last is not None:
            close()
            yield _digests(out)

    return examples.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    i, s = pa.int64(), pa.string()
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), [i, i, s, i, s, i])], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


#: The contract's extra conversation: control strings inside texts.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return read_back(expand(c.unionByName(probe)))
