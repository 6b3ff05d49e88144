"""Chat formatting in budgeted windows.

A conversation's turns, in order, fill windows of at most `budget` tokens. Running sums of the turns'
tokens choose the spans, which always end between turns; a turn that alone exceeds the budget gets a
window of its own and is never cut. Every window repeats the last system turn before it and as many of the
turns before it as fit into `history` tokens. Repeated turns carry no loss, so that each assistant
text is a target exactly once.

Control strings inside texts are escaped reversibly: every "<", backslashes, "|" gains a backslash.
Conversations stream through their task in turn order, so memory holds one window at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that the marks of a turn take.
TURN_TOKENS = 4
BUDGET, HISTORY = 1024, 256
OUT_ROWS = 256

WINDOWS = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("window", T.IntegerType()),
    T.StructField("n_repeated", T.IntegerType()),
    T.StructField("n_tokens", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
])
DIGESTS = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("n_turns", T.LongType()),
    T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()),
    T.StructField("loss_sha256", T.StringType()),
    T.StructField("formatted_chars", T.LongType()),
])


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def tokens(text: str) -> int:
    """Words and the marks of a turn: the measure of the budget."""
    return len(text.split()) + TURN_TOKENS


class Turn:
    __slots__ = ("head", "body", "size", "loss")

    def __init__(self, role: str, text: str):
        self.head = f"{START}{escape_role(role)}\n"
        self.body = escape(text)
        self.size = tokens(text)
        self.loss = role == "assistant"


def windows(turns: Iterator[tuple[str, str]], budget: int, history: int) -> Iterator[tuple[int, int, str, list[dict]]]:
    """(n_repeated, n_tokens, text, loss spans) of one conversation's windows."""
    system: Turn | None = None
    repeated: list[Turn] = []
    fresh: list[Turn] = []
    total = 0
    for role, text in turns:
        turn = Turn(role, text)
        if fresh and total + turn.size > budget:
            yield _window(repeated, fresh, total)
            base = system.size if system else 0
            room = min(history, budget - base - turn.size)
            past = [t for t in [*repeated, *fresh] if t is not system]
            kept: list[Turn] = []
            while past and past[-1].size <= room:
                room -= past[-1].size
                kept.append(past.pop())
            repeated = [system] * bool(system) + kept[::-1]
            fresh, total = [], sum(t.size for t in repeated)
        if role == "system":
            system = turn
        fresh.append(turn)
        total += turn.size
    if fresh:
        yield _window(repeated, fresh, total)


def _window(repeated: list[Turn], fresh: list[Turn], total: int) -> tuple[int, int, str, list[dict]]:
    parts, spans, at = [], [], 0
    for n, t in enumerate([*repeated, *fresh]):
        at += len(t.head)
        if n >= len(repeated) and t.loss:
            spans.append({"start": at, "end": at + len(t.body)})
        parts += [t.head, t.body, END, "\n"]
        at += len(t.body) + len(END) + 1
    return len(repeated), total, "".join(parts), spans


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _by_conversation(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    from itertools import groupby

    return groupby(rows, key=lambda r: r[0])


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows (conv_id, window, n_repeated, n_tokens, text, loss) of conversations (conv_id, turn, role, text).

    A null text or role is empty, a null turn comes first, and rows that tie on turn are ordered by
    role and text; repeated rows are turns of their own. Rows without conv_id form one conversation
    with a null id. Other columns are ignored. loss lists code point spans of text; the first
    n_repeated turns of a window were in an earlier one.
    """
    schema = _arrow(WINDOWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for conv, turns in _by_conversation(_rows(batches)):
                for n, w in enumerate(windows(((r[1] or "", r[2] or "") for r in turns), budget, history)):
                    yield conv, n, *w

        return _batched(rows(), schema)

    turns = conversations.select(F.col("conv_id").cast("bigint"), "turn", "role", "text")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return mapped(ordered.select("conv_id", "role", "text"), run, WINDOWS)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a window, unescaped."""
    out = []
    for part in text.split(END)[:-1]:
        role, _, body = part.removeprefix("\n").removeprefix(START).partition("\n")
        out.append((unescape_role(role), unescape(body)))
    return out


def read_back(formatted: DataFrame, ordered: bool = False) -> DataFrame:
    """Digests of each conversation as its windows hold it.

    ordered says that formatted comes straight from format_conversations, where the windows of a
    conversation already lie together and in order.
    """
    schema = _arrow(DIGESTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for conv, ws in _by_conversation(_rows(batches)):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n_turns = loss_chars = chars = 0
                for _, n_repeated, text, spans in ws:
                    for role, body in parse(text)[n_repeated:]:
                        turns.update(f"{role}\n{body}\n".encode())
                        n_turns += 1
                    for s in spans:
                        target = unescape(text[s["start"] : s["end"]])
                        loss.update(target.encode())
                        loss_chars += len(target)
                    chars += len(text)
                yield conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        return _batched(rows(), schema)

    if not ordered:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return mapped(formatted.select("conv_id", "n_repeated", "text", "loss"), run, DIGESTS)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back from the output."""
    said = f"{END}{START}assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("bigint"), "role", "text")
    return read_back(format_conversations(table.unionByName(probe)), ordered=True)
