"""Benchmark decontamination by template windows.

Words become template tokens: numbers, units and names turn into typed placeholders, other words
into lower case without outer punctuation. Windows of template tokens are hash-joined with those of
the benchmark; a document that holds most windows of an item in their order, words put in or left out
between them, is then checked slot by slot. If equal slots of the item always have equal values in the
document, and different slots different ones, the document leaks the item, word for word or with other
parameters; if they do not, it still leaks the item where most windows are there word for word.
A name at the start of a sentence looks like any other word there, so windows have a second template
in which such words are names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, mapped
from .shards import mix

WINDOW, CONTAINMENT = 5, 0.8
#: Words by which the alignment may shift from one matched window to the next.
SHIFT = 16
#: Benchmark texts of at most this many bytes are sent to the tasks as one index; a larger benchmark is joined by a shuffle.
INDEX_BYTES = 32 << 20
CACHED_WORDS = 300_000
#: Words of texts that are looked up together.
TOGETHER = 1 << 15
#: Bits of a hash that say at once that most windows are not in the index, beyond those that number its windows.
SIEVE = 4
#: Words that are units after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi mile miles inch inches foot feet meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "% percent degrees degree celsius fahrenheit kelvin volt volts watt watts kw mph kmh "
    "dollar dollars euro euros cent cents usd eur gbp yen".split()
)
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*$")
MEASURE = re.compile(r"([+-]?\d[\d.,:/]*)([^\W\d_]+|[%°€$£¥]+)$")
MONEY = re.compile(r"([€$£¥])([+-]?\d[\d.,:/]*)$")
OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "%$") + "“”‘’«»…–—"
LITERAL, NUM, UNIT, NAME = range(4)


#: White space for str.split that does not separate words here.
ODD_SPACES = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CLOSERS = "\"')]}”’»"


_hash = xxhash.xxh64_intdigest


NUM_HASH, UNIT_HASH, NAME_HASH, MEASURE_HASH = map(_hash, ("<num>", "<unit>", "<name>", "<num><unit>"))


class Templates:
    """Words as template tokens; remembers the words it has met."""

    def __init__(self):
        self.index: dict[str, int] = {}
        # for each word: its token in the middle of a sentence, at its start and after a number
        self.tokens = np.zeros((CACHED_WORDS, 3), np.uint64)
        self.kinds = np.zeros((CACHED_WORDS, 3), np.int8)
        self.ends = np.zeros(CACHED_WORDS, bool)
        self.number = np.zeros(CACHED_WORDS, bool)

    def add(self, words: list[str]) -> None:
        """Remember words that are new, each once."""
        at = len(self.index)
        own = slice(at, at + len(words))
        self.index.update(zip(words, range(at, at + len(words))))
        cores = [w.strip(OUTER) for w in words]
        lows = [c.lower() for c in cores]
        self.tokens[own] = np.fromiter(map(_hash, lows), np.uint64, len(lows))[:, None]
        self.kinds[own], self.ends[own] = LITERAL, False
        numbers, measures, names, units, ends = [], [], [], [], []
        for k, (word, core, low) in enumerate(zip(words, cores, lows), at):
            plain = core.isalpha()
            if not (plain and word == low):
                if word.rstrip(CLOSERS)[-1:] in (".", "!", "?", ":", "…"):
                    ends.append(k)
                if not plain and NUMBER.match(core):
                    numbers.append(k)
                    continue
                if not plain and (MEASURE.match(core) or MONEY.match(core)):
                    measures.append(k)
                    continue
                if len(core) > 1 and core[0].isupper() and core[1:].islower():
                    names.append(k)
            if low in UNITS:
                units.append(k)
        self.tokens[numbers], self.kinds[numbers] = NUM_HASH, NUM
        self.tokens[measures], self.kinds[measures] = MEASURE_HASH, UNIT
        for state in (0, 2):
            self.tokens[names, state], self.kinds[names, state] = NAME_HASH, NAME
        self.tokens[units, 2], self.kinds[units, 2] = UNIT_HASH, UNIT
        self.ends[ends] = True
        self.number[own] = self.kinds[own, 0] == NUM

    def of(self, words: list[str], begin: np.ndarray | tuple[int, ...] = (0,)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token hashes and kinds of the words of texts that begin there, and where a capitalised word starts a sentence."""
        if len(self.index) + len(words) > len(self.ends):
            self.index.clear()
            if len(words) > len(self.ends):  # a text of more words than are remembered
                self.tokens, self.kinds = np.zeros((len(words), 3), np.uint64), np.zeros((len(words), 3), np.int8)
                self.ends, self.number = np.zeros(len(words), bool), np.zeros(len(words), bool)
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(at < 0)):
            unknown = [words[j] for j in new.tolist()]
            self.add(list(dict.fromkeys(unknown)))
            at[new] = [self.index[w] for w in unknown]
        state = np.zeros(len(at), np.int64)
        if len(at):
            state[1:][self.number[at[:-1]]] = 2
            state[1:][self.ends[at[:-1]]] = 1
            state[np.asarray(begin)] = 1
        return self.tokens[at, state], self.kinds[at, state], (state == 1) & (self.kinds[at, 0] == NAME)


def split(text: str) -> list[str]:
    odd = any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else ODD_SPACES.search(text)
    return re.findall(r"[^\x20\x09-\x0D]+", text) if odd else text.split()


def with_names(tokens: np.ndarray, kinds: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The second template: capitalised words at the start of a sentence are names."""
    return np.where(starts, np.uint64(NAME_HASH), tokens), np.where(starts, NAME, kinds)


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    n = len(tokens) - size + 1
    h = tokens[: max(n, 0)].copy()
    for i in range(1, size):
        h = mix(h * np.uint64(3)) + tokens[i : n + i] if n > 0 else h
    return mix(h)


class Benchmark:
    """A block of benchmark items, indexed by their template windows."""

    def __init__(self, items: list[tuple[int, str]]):
        self.templates = Templates()
        self.items = []
        self.by_size: dict[int, tuple[np.ndarray, ...]] = {}
        found: dict[int, list[tuple[int, int, int, bool]]] = defaultdict(list)
        for item, text in items:
            words = split(text or "")
            if not words:
                continue
            tokens, kinds, starts = self.templates.of(words)
            named, named_kinds = with_names(tokens, kinds, starts)
            size = min(WINDOW, len(words))
            literal = np.convolve(kinds == LITERAL, np.ones(size, int), "valid")
            places = np.flatnonzero(literal * 2 >= size)
            if not len(places):
                places = np.arange(len(literal))
            hashes, second = window_hashes(tokens, size), window_hashes(named, size)
            for p in places.tolist():
                found[size].append((int(hashes[p]), len(self.items), p, True))
                if hashes[p] != second[p]:
                    found[size].append((int(second[p]), len(self.items), p, False))
            self.items.append((item, [w.strip(OUTER).lower() for w in words], kinds, named_kinds, len(places), size))
        self.windows = np.array([own[4] for own in self.items])
        for size, rows in found.items():
            rows.sort()
            self.by_size[size] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]))
        # for each size, whether a window of the index has these leading bits
        self.sieves: dict[int, tuple[np.uint64, np.ndarray]] = {}
        for size, (hashes, *_) in self.by_size.items():
            bits = min(len(hashes).bit_length() + SIEVE, 24)
            sieve = np.zeros(1 << bits, bool)
            sieve[hashes >> np.uint64(64 - bits)] = True
            self.sieves[size] = np.uint64(64 - bits), sieve

    def leaks(self, text: str | None) -> list[tuple[int, str, int, int, int]]:
        """(item, kind, matched windows, first word, words) of the items that a text leaks."""
        return next(self.leaks_of([text]))

    def leaks_of(self, texts: list[str | None]) -> Iterator[list[tuple[int, str, int, int, int]]]:
        """The leaks of each text; short texts are looked up together."""
        group, n = [], 0
        for text in texts:
            words = split(text or "")
            group.append(words)
            n += len(words)
            if n >= TOGETHER:
                yield from self._leaks(group)
                group, n = [], 0
        yield from self._leaks(group)

    def _leaks(self, texts: list[list[str]]) -> list[list[tuple[int, str, int, int, int]]]:
        out: list[list] = [[] for _ in texts]
        words = [w for own in texts for w in own]
        if not words:
            return out
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(texts)), sizes)
        tokens, kinds, starts = self.templates.of(words, begin[sizes > 0])
        named, named_kinds = with_names(tokens, kinds, starts)
        for size in self.by_size:
            for t, i, places in self._hits(tokens, named, of, begin, size):
                own = slice(begin[t], begin[t] + sizes[t])
                if best := self._best(i, places, texts[t], kinds[own], named_kinds[own]):
                    out[t].append(best)
        for found in out:
            found.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        return out

    def _hits(self, tokens, named, of, begin, size: int) -> Iterator[tuple[int, int, dict[tuple[int, int], bool]]]:
        """(text, item, {(word, place): by the first template}) where a text holds most windows of an item."""
        hashes, owner, place, plain = self.by_size[size]
        shift, sieve = self.sieves[size]
        own = window_hashes(tokens, size)
        if not len(own):
            return
        inside = of[: len(own)] == of[size - 1 :]
        second = window_hashes(named, size)
        found = []
        for first, h, where in ((True, own, inside), (False, second, inside & (second != own))):
            at = np.flatnonzero(sieve[h >> shift] & where)
            low = np.searchsorted(hashes, h[at])
            n = np.searchsorted(hashes, h[at], "right") - low
            w = np.repeat(at, n)
            k = np.arange(len(w)) + np.repeat(low - (np.cumsum(n) - n), n)
            found.append((w, k, plain[k] if first else np.zeros(len(k), bool)))
        w, k, first = map(np.concatenate, zip(*found))
        if not len(w):
            return
        pair = of[w] * len(self.items) + owner[k]
        width = int(place.max()) + 1
        pairs, n = np.unique(np.unique(pair * width + place[k]) // width, return_counts=True)
        pairs = pairs[n >= CONTAINMENT * self.windows[pairs % len(self.items)]]
        if not len(pairs):
            return
        keep = np.flatnonzero(np.isin(pair, pairs))
        hits: dict[int, dict[tuple[int, int], bool]] = defaultdict(dict)
        for x, at, p, by in zip(pair[keep].tolist(), (w - begin[of[w]])[keep].tolist(), place[k][keep].tolist(), first[keep].tolist()):
            hits[x][at, p] = hits[x].get((at, p), False) or by
        for x, places in hits.items():
            yield *divmod(x, len(self.items)), places

    def _best(self, i: int, places: dict[tuple[int, int], bool], words: list[str], kinds, named_kinds) -> tuple[int, str, int, int, int] | None:
        """The leak of an item most of whose windows a text holds."""
        item, values, item_kinds, item_named, n, size = self.items[i]
        best = None
        # one alignment for all windows of the first template
        for offset, matched in Counter(w - p for (w, p), first in places.items() if first).most_common():
            if matched < CONTAINMENT * n or best and best[1] == "exact":
                break
            kind = self._slots(values, item_kinds, words, kinds, [(p, p + offset) for p in range(len(values))])
            if kind and (best is None or kind == "exact"):
                best = (item, kind, matched, max(offset, 0), len(values))
        if best is None or best[1] != "exact":
            for chain in chains(sorted(places), CONTAINMENT * n):
                pairs = {p + k: w + k for w, p in reversed(chain) for k in range(size)}
                kind = self._slots(values, item_named, words, named_kinds, sorted(pairs.items()))
                if kind is None:
                    same = sum([w.strip(OUTER).lower() for w in words[at : at + size]] == values[p : p + size] for at, p in chain)
                    kind = "near" if same >= CONTAINMENT * n else None
                if kind and (best is None or kind == "exact"):
                    best = (item, kind, len(chain), max(chain[0][0] - chain[0][1], 0), len(values))
                if best and best[1] == "exact":
                    break
        return best

    @staticmethod
    def _slots(values, item_kinds, words, kinds, pairs) -> str | None:
        """exact, reparameterised or, where slots contradict each other, None; pairs are (place, word) aligned."""
        there: dict[tuple[int, str], str] = {}
        back: dict[tuple[int, str], str] = {}
        same = True
        for p, w in pairs:
            if item_kinds[p] == LITERAL or not 0 <= w < len(words) or kinds[w] != item_kinds[p]:
                continue
            kind, a, b = int(item_kinds[p]), values[p], words[w].strip(OUTER).lower()
            if there.setdefault((kind, a), b) != b or back.setdefault((kind, b), a) != a:
                return None
            same &= a == b
        return "exact" if same else "reparameterised"


def chains(hits: list[tuple[int, int]], least: float) -> Iterator[list[tuple[int, int]]]:
    """Chains of at least so many (word, place) hits, both growing, the longest first.

    hits are sorted. From one hit to the next the alignment shifts by SHIFT words at most. On one
    diagonal each hit can follow the one before, so lengths grow along it, and of each diagonal
    nearby only the last hit that lies before is looked at.
    """
    lines: dict[int, tuple[list[int], list[int]]] = {}  # diagonal: words, numbers of hits
    length, before, head = [0] * len(hits), [-1] * len(hits), list(range(len(hits)))
    for i, (w, p) in enumerate(hits):
        o = w - p
        for d in range(o - SHIFT, o + SHIFT + 1):
            line = lines.get(d)
            if line and (k := bisect_left(line[0], min(w, p + d)) - 1) >= 0:
                j = line[1][k]
                # of equal lengths the one with the least shift
                if length[j] > length[i] - 1 or length[j] == length[i] - 1 and abs(d - o) < abs(hits[before[i]][0] - hits[before[i]][1] - o):
                    length[i], before[i], head[i] = length[j] + 1, j, head[j]
        length[i] = length[i] or 1
        line = lines.setdefault(o, ([], []))
        line[0].append(w)
        line[1].append(i)
    tried = set()
    for i in sorted(range(len(hits)), key=lambda i: -length[i]):
        if length[i] < least:
            return
        if head[i] not in tried:
            tried.add(head[i])
            chain = []
            while i >= 0:
                chain.append(hits[i])
                i = before[i]
            yield chain[::-1]


LEAKS = "item_id long, kind string, matched long, first_word long, n_words long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, kind, matched, first_word, n_words), a row for each item that a document leaks.

    kind is exact, reparameterised where slots have other values, or near where these contradict each
    other but most windows are there word for word. Items without words leak
    nowhere, null and empty texts leak nothing, items of fewer than WINDOW words are one window, and
    repeated rows or items give rows of their own. An empty benchmark gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    items = benchmark.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *T.StructType.fromDDL(LEAKS).fields])
    if not _small(items):
        return _joined_leaks(rows, items, schema)
    index = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Benchmark(index.value)
        for batch in batches:
            yield _table([(d, *leak) for d, own in zip(batch.column(0).to_pylist(), found.leaks_of(batch.column(1).to_pylist())) for leak in own], schema)

    return mapped(rows, run, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that leak an item of the benchmark; other rows stay as they are."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    at = docs.columns.index(text_col)
    if not _small(items):
        name = _name(F.col(f"`{text_col}`"))
        texts = docs.where(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{text_col}`").alias("text")).distinct()
        gone = _candidates(texts, items).transform(_verified, T.StructType.fromDDL(f"name string, {LEAKS}")).select("name").distinct()
        return docs.join(gone, name.eqNullSafe(gone["name"]), "left_anti")
    index = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Benchmark(index.value)
        for batch in batches:
            yield batch.filter(pa.array([not own for own in found.leaks_of(batch.column(at).to_pylist())], pa.bool_()))

    out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return mapped(out, run, out.schema).toDF(*docs.columns)


def _small(items: DataFrame) -> bool:
    return (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= INDEX_BYTES


def _table(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in schema.fields]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], schema.names)


def _name(text: Column) -> Column:
    return F.sha2(text, 256)


def _item_windows(items: DataFrame) -> DataFrame:
    """(size, hash, name, places, place): the windows of each item's text under both templates."""
    schema = T.StructType.fromDDL("size long, hash long, name string, places long, place long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = Benchmark([(0, text)])
                rows = []
                for size, (hashes, _, place, _) in own.by_size.items():
                    rows += [(size, h, name, own.items[0][4], p) for h, p in zip(hashes.view(np.int64).tolist(), place.tolist())]
                yield _table(rows, schema)

    return mapped(items.select(_name(F.col("text")).alias("name"), "text"), run, schema).distinct()


def _text_windows(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(size, hash, name): the different windows of each text under both templates."""
    schema = T.StructType.fromDDL("size long, hash long, name string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens, kinds, starts = templates.of(split(text))
                for size in sizes:
                    both = np.unique(np.concatenate([window_hashes(t, size) for t in (tokens, with_names(tokens, kinds, starts)[0])]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(both), size)), pa.array(both.view(np.int64)), pa.array([name] * len(both), pa.string())], schema.names)

    return mapped(texts.select(_name(F.col("text")).alias("name"), "text"), run, schema)


def _candidates(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(name, text, item_text, ids): texts with items most of whose windows they hold, by a hash join of windows."""
    windows = cut(_item_windows(items))
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # WINDOW at most
    hits = _text_windows(texts, sizes).join(windows.withColumnRenamed("name", "item"), ["size", "hash"])
    counted = hits.groupBy("name", "item").agg(F.count_distinct("place").alias("n"), F.first("places").alias("places"))
    pairs = counted.where(F.col("n") >= CONTAINMENT * F.col("places")).select("name", "item")
    named = texts.select(_name(F.col("text")).alias("name"), "text")
    own = items.select(_name(F.col("text")).alias("item"), F.col("text").alias("item_text"), "item_id")
    return pairs.join(named, "name").join(own, "item").select("name", "text", "item_text", "item_id")


def _verified(candidates: DataFrame, schema: T.StructType) -> DataFrame:
    """The leaks among candidates, by the same test as the index's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text, item_text, item in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(name, item, *leak[1:]) for leak in Benchmark([(item, item_text)]).leaks(text)]
            yield _table(rows, schema)

    return mapped(candidates, run, schema)


def _joined_leaks(rows: DataFrame, items: DataFrame, schema: T.StructType) -> DataFrame:
    """The leaks of rows (doc_id, text) without an index: equal texts are searched once."""
    texts = rows.where("text is not null").select("text").distinct()
    found = _verified(_candidates(texts, items), T.StructType.fromDDL(f"name string, {LEAKS}"))
    named = rows.select("doc_id", _name(F.col("text")).alias("name"))
    return named.join(found, "name").select(*schema.names)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks of all documents: doc_id, item_id, kind, matched windows and where they start."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
