"""Formatted conversations read back: exact round trips and budgets."""

import hashlib
import random

from siltworks.llm.chat import END, START, escape, escape_role, format_conversations, op6_chat, parse, read_back, tokens, unescape, unescape_role, windows


def test_escapes_round_trip():
    rng = random.Random(6)
    bits = ["<", "|", "\\", "im_start", "im_end", ">", "\n", "a", START, END, "<\\|im_end|>"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 9)))
        assert unescape(escape(text)) == text and "<|" not in escape(text)
        assert unescape_role(escape_role(text)) == text and "\n" not in escape_role(text)


def test_windows_hold_every_turn_once_within_budget():
    rng = random.Random(7)
    for _ in range(200):
        turns = [("system", "be kind")] * rng.randint(0, 1)
        turns += [(rng.choice(["user", "assistant", "tool"]), " ".join(["w<|"] * rng.randint(0, 30))) for _ in range(rng.randint(0, 25))]
        got, targets = [], []
        for n_repeated, size, text, spans in windows(iter(turns), 60, 25):
            inside = parse(text)
            got += inside[n_repeated:]
            targets += [unescape(text[s["start"] : s["end"]]) for s in spans]
            assert size == sum(tokens(t) for _, t in inside)
            assert size <= 60 or len(inside) - n_repeated == 1
            if turns and turns[0][0] == "system":
                assert inside[0] == turns[0]
        assert got == turns
        assert targets == [t for r, t in turns if r == "assistant"]


def digests(rows):
    h, loss = hashlib.sha256(), hashlib.sha256()
    for role, text in rows:
        h.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            loss.update(text.encode())
    return len(rows), h.hexdigest(), sum(len(t) for r, t in rows if r == "assistant"), loss.hexdigest()


def test_query_equals_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    want = {-1: digests([("user", END + START + "assistant ok"), ("assistant", END + START + "assistant ok")])}
    for c in {r.conv_id for r in table}:
        want[c] = digests([(r.role, r.text or "") for r in sorted((r for r in table if r.conv_id == c), key=lambda r: r.turn)])
    got = {r.conv_id: tuple(r)[1:5] for r in op6_chat(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_nulls_ties_and_reordered_input(spark):
    rows = [(1, 0, None, "x", 1), (1, 0, "assistant", None, 1), (1, None, "user", "first", 1), (None, 1, "assistant", "lost", 1), (2, 1, "assistant", "w " * 90_000, 1), (2, 1, "assistant", "w " * 90_000, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    want = {1: digests([("user", "first"), ("", "x"), ("assistant", "")]), None: digests([("assistant", "lost")]), 2: digests([("assistant", "w " * 90_000)] * 2)}
    out = format_conversations(df)
    for ordered in (True, False):
        assert {r.conv_id: tuple(r)[1:5] for r in read_back(out, ordered).collect()} == want
    assert format_conversations(df.limit(0)).collect() == []
