"""Repair of the structure of conversations at the least cost.

Roles must follow (s?(ua)+)?. A row is kept, given the role user or assistant, or deleted, and empty
rows can be inserted; the cheapest edits win, of equal ones the least in ASCII order.

A conversation's rows become a signature of one letter each, which is all that the edits depend on.
Signatures are dealt out in order (a frequent one over several tasks, by conversation) and each task
walks its sorted run as a prefix trie: the stack holds one layer of the dynamic programme for each
letter of the present path, shared by all signatures that begin so; a new signature goes back to
what it has in common with the last one and adds layers from there. Answers are read
at terminal nodes. Texts travel once, for the digest of the repaired conversation; before that only
digests of texts do. Rows of a conversation stream through its task in order, because a digest is sequential; what
a task holds of it is one letter and one reference for each row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, mapped

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States after: nothing, a system row, a user row, an assistant row; a conversation ends in the first or the last.
ENDS = (0, 3)
#: The state after a user or assistant row that is inserted or given its role in each state.
NEXT = (2, 2, 3, 2)
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE = {2: "user", 3: "assistant"}


class Layer:
    """The best edits in each state after some rows: (cost beyond the layer's least, rank, inserts, state before, edit).

    Edits up to the last row are ranked in ASCII order; no two that differ are prefixes of one another, as both
    end with the same row's edit. Inserts that follow are only counted. Equal layers are one object.
    """

    __slots__ = ("states", "after")
    known: dict[tuple, Layer] = {}

    def __init__(self, states: tuple):
        self.states = states
        self.after: dict[str, tuple[Layer, int]] = {}

    @classmethod
    def settled(cls, base: list[tuple | None]) -> tuple[Layer, int]:
        """The layer of base, (cost, order of the edits, state before, edit) by state, after inserts, and its least cost."""
        best: list[tuple | None] = [b and (b[0], b[1], 0, b[2], b[3]) for b in base]
        for b, s in zip(base, range(4)):
            for n in (1, 2):
                s = NEXT[s]
                if b and (best[s] is None or (b[0] + n * INSERT, b[1], n) < best[s][:3]):
                    best[s] = (b[0] + n * INSERT, b[1], n, b[2], b[3])
        least = min(b[0] for b in best if b)
        ranks = {order: n for n, order in enumerate(sorted({b[1] for b in best if b}))}
        states = tuple(b and (b[0] - least, ranks[b[1]], *b[2:]) for b in best)
        return cls.known.setdefault(states, cls(states)), least

    def step(self, letter: str) -> tuple[Layer, int]:
        """The layer after one more row, and what the least cost grows by."""
        if letter not in self.after:
            base: list[tuple | None] = [None] * 4
            late = TRUNCATED * letter.isupper()
            for s, entry in enumerate(self.states):
                if not entry:
                    continue
                cost, rank, inserts = entry[:3]
                edits = [("D", s, DELETE)]
                if letter != "d":
                    edits.append(("R", NEXT[s], REROLE + late))
                    if letter.lower() in KEPT[s]:
                        edits.append(("K", KEPT[s][letter.lower()], KEEP + late))
                for edit, to, price in edits:
                    new = (cost + price, (rank, "I" * inserts + edit), s, edit)
                    if base[to] is None or new[:2] < base[to][:2]:
                        base[to] = new
            self.after[letter] = Layer.settled(base)
        return self.after[letter]


class Trie:
    """The path of the present signature in the trie of sorted signatures."""

    def __init__(self):
        first, cost = Layer.settled([(0, (0, ""), 0, ""), None, None, None])
        self.layers, self.costs, self.path = [first], [cost], ""

    def answer(self, signature: str) -> tuple[int, str]:
        """(cost, audit) of a signature; layers of what it shares with the last one are used again."""
        shared = common_prefix(self.path, signature)
        del self.layers[shared + 1 :], self.costs[shared + 1 :]
        for letter in signature[shared:]:
            layer, more = self.layers[-1].step(letter)
            self.layers.append(layer)
            self.costs.append(self.costs[-1] + more)
        self.path = signature
        _, s = min((self.layers[-1].states[s][:3], s) for s in ENDS if self.layers[-1].states[s])
        cost = self.costs[-1] + self.layers[-1].states[s][0]
        out = []
        for layer in reversed(self.layers):
            _, _, inserts, before, edit = layer.states[s]
            out.append(edit + "I" * inserts)
            s = before
        return cost, "".join(reversed(out))


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high - 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def repaired(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows after the edits of audit."""
    state = 0
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield ROLE[state], ""
            continue
        role, text = next(rows)
        if edit == "K":
            state = KEPT[state][role[:1]]
            yield role, text
        elif edit == "R":
            state = NEXT[state]
            yield ROLE[state], text


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copy) after the planned damage; a dropped row stays with a null copy."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("k"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.expr("CASE k WHEN 0 THEN array(cast(null as int)) WHEN 3 THEN array(0, 1) ELSE array(0) END")).alias("copy"))


ORDER = ["turn", "role", "digest", "copy"]
AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature) of rows (conv_id, turn, role, text, copy).

    A letter is the role's initial (x for others than s, u and a), in capitals for a truncated row; d is a row that must go.
    """
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    marked = rows.select(
        "conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), "copy", F.substring("role", 1, 1).alias("initial"),
        (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"))
    # both orders are of the rows of one conversation, so one shuffle serves them
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy("turn", "copy")
    # a dropped row has no copy, and repeats nothing
    again = F.count("copy").over(seen.rowsBetween(Window.unboundedPreceding, -1)) > 0
    marked = marked.repartition("conv_id").withColumn("again", again)
    ordered = marked.sortWithinPartitions("conv_id", *ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        for conv, own in groupby(stream, key=lambda r: r[0]):
            letters: list[str] = []
            blank = duplicate = truncated = illegal = turns = 0
            low = high = before = None
            for _, turn, initial, empty, late, again, copy in own:
                if copy is None:
                    continue
                if turn is not None and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
                if before is not None and before + initial not in ("su", "ua", "au"):
                    illegal += 1
                before = initial
                letter = initial if initial in ("s", "u", "a") else "x"
                if empty:
                    blank, letter = blank + 1, "d"
                elif again:
                    duplicate, letter = duplicate + 1, "d"
                elif late:
                    truncated, letter = truncated + 1, letter.upper()
                letters.append(letter)
            gaps = high - low + 1 - turns if turns else 0
            out.append((conv, gaps, blank, duplicate, truncated, illegal, "".join(letters)))
            if len(out) == 1000:
                yield _batch(out, SIGNED)
                out = []
        if out:
            yield _batch(out, SIGNED)

    return mapped(ordered.select("conv_id", "turn", "initial", "blank", "truncated", "again", "copy"), run, AUDIT)


SIGNED = pa.schema([(n, pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal")] + [("signature", pa.string())])
ANSWERED = pa.schema([*SIGNED][:6] + [pa.field("cost", pa.int64()), pa.field("audit", pa.string())])
DIGESTED = ANSWERED.append(pa.field("repaired_sha256", pa.string()))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema)


def answers(signed: DataFrame) -> DataFrame:
    """signed with cost and audit instead of the signature, by walks along sorted runs of signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, answer = Trie(), None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some, out = batch.slice(lo, 1000), []
                for row in zip(*(c.to_pylist() for c in some.columns)):
                    if row[6] != last:
                        last, answer = row[6], trie.answer(row[6])
                    out.append((*row[:6], *answer))
                yield _batch(out, ANSWERED)

    dealt = signed.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature", "conv_id")
    return mapped(dealt, run, _ddl(ANSWERED))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv_id, turn, role, text, copy).

    Rows go by turn, a null turn first; rows that tie are ordered by role and the digest of the text, repeated
    rows being rows of their own. Rows without conv_id form one conversation with a null id. A
    row of a null copy only says that its conversation exists; one of no other rows gets zeros, an empty
    audit and the digest of an empty string. Other columns are ignored.
    """
    heads = answers(signatures(rows)).select("*", F.lit(0).alias("kind"))
    texts = rows.where("copy is not null").select("conv_id", "turn", "role", "text", F.unhex(F.md5("text")).alias("digest"), "copy", F.lit(1).alias("kind"))
    both = heads.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        for _, own in groupby(stream, key=lambda r: r[0]):
            head = next(own)[:8]
            digest, mark = hashlib.sha256(), b""
            for role, text in repaired((r[8:10] for r in own), head[7]):
                digest.update(mark + f"{role}:{text}".encode())
                mark = b"\n"
            out.append((*head, digest.hexdigest()))
            if len(out) == 1000:
                yield _batch(out, DIGESTED)
                out = []
        if out:
            yield _batch(out, DIGESTED)

    return mapped(both.select(*ANSWERED.names, "role", "text"), run, _ddl(DIGESTED))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged as planned, and their repair."""
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: The query in DuckDB: the dynamic programme with whole strings, one row of a conversation at a time.
OP13_SQL = r"""WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
z AS (SELECT *, xor(4294967295, list_reduce([CAST(4294967295 AS UBIGINT)] || flatten(list_transform(string_split(name, ''), lambda c: [CAST(ascii(c) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0])),
  lambda y, v: xor(xor(y, v) >> 1, (xor(y, v) & 1) * 3988292384))) % 20 AS k FROM o),
d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM z WHERE k <> 0),
n AS (SELECT *, row_number() OVER w AS i, left(role, 1) AS h, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e,
  lag(left(role, 1)) OVER w AS b, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
f AS (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (b || h NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows_left FROM f GROUP BY conv_id),
p(conv_id, i, x0, x1, x2, x3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {'c': 0::BIGINT, 'a': ''}, {'c': 1000000000::BIGINT, 'a': ''}, {'c': 3::BIGINT, 'a': 'I'}, {'c': 6::BIGINT, 'a': 'II'} FROM s
  UNION ALL
  SELECT conv_id, i, b0, b1,
    list_min([b2, {'c': b0.c + 3, 'a': b0.a || 'I'}, {'c': b1.c + 3, 'a': b1.a || 'I'}, {'c': b3.c + 3, 'a': b3.a || 'I'}]),
    list_min([b3, {'c': b2.c + 3, 'a': b2.a || 'I'}, {'c': b0.c + 6, 'a': b0.a || 'II'}, {'c': b1.c + 6, 'a': b1.a || 'II'}])
  FROM (SELECT conv_id, i, {'c': x0.c + 4, 'a': x0.a || 'D'} AS b0,
    list_min([{'c': x1.c + 4, 'a': x1.a || 'D'}, {'c': x0.c + t + CASE h WHEN 's' THEN 0 ELSE 1000000000 END, 'a': x0.a || 'K'}]) AS b1,
    list_min([{'c': x2.c + 4, 'a': x2.a || 'D'}, {'c': x0.c + t + 3, 'a': x0.a || 'R'}, {'c': x1.c + t + 3, 'a': x1.a || 'R'}, {'c': x3.c + t + 3, 'a': x3.a || 'R'},
      {'c': x0.c + t + u, 'a': x0.a || 'K'}, {'c': x1.c + t + u, 'a': x1.a || 'K'}, {'c': x3.c + t + u, 'a': x3.a || 'K'}]) AS b2,
    list_min([{'c': x3.c + 4, 'a': x3.a || 'D'}, {'c': x2.c + t + 3, 'a': x2.a || 'R'}, {'c': x2.c + t + CASE h WHEN 'a' THEN 0 ELSE 1000000000 END, 'a': x2.a || 'K'}]) AS b3
    FROM (SELECT p.*, f.i AS j, f.h, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 3 ELSE 1000000000 END AS t, CASE f.h WHEN 'u' THEN 0 ELSE 1000000000 END AS u
      FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1) AS q(conv_id, i0, x0, x1, x2, x3, i, h, t, u)) AS r),
a AS (SELECT p.conv_id, list_min([p.x0, p.x3]) AS best FROM p JOIN s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = s.rows_left),
c AS (SELECT conv_id, best.a AS audit, unnest(string_split(best.a, '')) AS edit, generate_subscripts(string_split(best.a, ''), 1) AS j FROM a WHERE best.a <> ''),
g AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i FROM c),
m AS (SELECT g.conv_id, g.j, g.edit, f.role, f.text, count(*) FILTER (edit <> 'D' AND NOT (edit = 'K' AND f.h = 's')) OVER (PARTITION BY g.conv_id ORDER BY g.j) AS place
  FROM g LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i AND g.edit <> 'I'),
r AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS t FROM m WHERE edit <> 'D' GROUP BY conv_id),
v AS (SELECT DISTINCT conv_id FROM conversations)
SELECT v.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(r.t, '')) AS repaired_sha256
FROM v LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id"""
