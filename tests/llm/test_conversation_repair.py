"""Repair of conversations against an exhaustive search and a plain replay."""

import hashlib
import heapq
import random
import re
import zlib

from siltworks.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, audit string, kind int"


def cheapest(letters):
    """(cost, audit) by Dijkstra's search with whole strings."""
    todo, done = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, state = heapq.heappop(todo)
        if i == len(letters) and state in (0, 3):
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        to = 3 if state == 2 else 2
        heapq.heappush(todo, (cost + 3, audit + "I", i, to))
        if i < len(letters):
            x = letters[i]
            late = 3 * x.isupper()
            heapq.heappush(todo, (cost + 4, audit + "D", i + 1, state))
            if x != "d":
                heapq.heappush(todo, (cost + 3 + late, audit + "R", i + 1, to))
                kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((x.lower(), state))
                if kept:
                    heapq.heappush(todo, (cost + late, audit + "K", i + 1, kept))


def test_sorted_signatures_share_layers():
    rng = random.Random(1)
    found = sorted({"".join(rng.choices("suaxdSUAX", k=rng.randint(0, 9))) for _ in range(3000)} | {"".join(rng.choices("ua", k=150)) for _ in range(5)})
    trie = C.Trie()
    for s in found:
        assert trie.answer(s) == cheapest(s), s
    # a few shapes of layers serve all of them
    assert len(C.Layer.known) < 5000
    assert C.common_prefix("abcd", "abxy") == 2 and C.common_prefix("", "a") == 0 and C.common_prefix("ab", "ab") == 2 and C.common_prefix("b", "a") == 0


def replay(rows):
    """The query's result by plain Python over rows (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = convs.setdefault(conv, [])
        if k == 0:
            continue
        role, text = ("user" if k == 4 else role), ("" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        own += [(turn, role, text)] * (2 if k == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        letters, counts, seen = "", [0, 0, 0], set()
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            x = role[:1] if role[:1] in ("s", "u", "a") else "x"
            letters += "d" if fault in (0, 1) else x.upper() if fault == 2 else x
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = cheapest(letters)
        text = "\n".join(f"{r}:{t}" for r, t in C.repaired(((r, t) for _, r, t in own), audit))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_query_equals_replay(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = C.op13_conversation_repair(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=repr) == replay([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_nulls_ties_repeats_and_long_conversations(spark):
    rng = random.Random(2)
    texts = ["Yes.", "No", "", " \n", "Well, well!", None, "x" * 200_000 + "?", "\x1c", "…", "A. "]
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", None, "", "U"]), rng.choice(texts)) for _ in range(300)]
    rows += [(99, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(1500)]
    # conversations that lose all their rows
    rows += [(c, 0, "user", "gone") for c in range(1000, 1400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA)
    got = C.repair(C.damaged(df))
    assert sorted(map(tuple, got.collect()), key=repr) == replay(rows)
    assert C.repair(C.damaged(df.limit(0))).collect() == []


def test_edits_can_be_read_from_the_audit():
    rows = [("system", "s"), ("user", "q"), ("user", "r"), ("assistant", "a")]
    assert list(C.repaired(iter(rows), "KKRDI")) == [("system", "s"), ("user", "q"), ("assistant", "r"), ("user", "")]
