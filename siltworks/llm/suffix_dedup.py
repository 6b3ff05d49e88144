"""Byte-level substring dedup by suffix arrays of shards.

Every window of 400 bytes goes to a shard by the smallest hash of its 32-byte grams, consecutive
windows as one run. A shard's runs are joined into one string whose suffixes are sorted by induced
sorting: suffixes are classified as larger or smaller than their right neighbour, the substrings
between leftmost-smaller positions are sorted and named, the string of names is sorted recursively,
and the order of all suffixes is induced from it in two linear scans. Permuted common prefixes are
then computed in text order: only where the preceding bytes differ are characters compared, every
other value is the last one less one. A window that shares 400 bytes with a neighbour in the suffix
order is repeated.

The scans run bucket by bucket over whole arrays. Strings over more than MANY_NAMES symbols, which
arise only in the recursion, end it by doubling the ranked prefixes, because buckets would be too
small for arrays to pay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, sha256_hex
from .shards import COLUMNS, Runs, intervals, joined, keyed, mix, prefix_hash, shards_for, slice_hash, sliding_min, spans_of_shards, to_shards, with_spans

WINDOW, GRAM = 400, 32
MANY_NAMES = 2048
END_OF_RUN, END_OF_ALL = 1, 0
#: Bits for a place in the bytes that are hashed together; the others order the grams.
PLACE_BITS = 23


def _placed_at(symbols: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by symbol, the count of each symbol, and each sorted item's place in its group."""
    order = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols, minlength=size)
    place = np.arange(len(symbols)) - (np.cumsum(counts) - counts)[symbols[order]]
    return order, counts, place


def _induced(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, induced from the leftmost-smaller ones in the given order."""
    n = len(text)
    counts = np.bincount(text, minlength=size)
    tail = np.cumsum(counts)
    head = tail - counts
    order, own, place = _placed_at(text[seeds], size)
    sorted_seeds = seeds[order]
    seed_end = np.cumsum(own)
    out = np.full(n, -1, np.int64)
    symbols = np.flatnonzero(counts)
    # larger suffixes, from the front: each bucket is scanned until it stops growing, then its seeds
    fill = head.copy()

    def put(after: np.ndarray) -> None:
        before = after - 1
        before = before[before >= 0]
        before = before[~smaller[before]]
        if len(before):
            order, added, place = _placed_at(text[before], size)
            items = before[order]
            c = text[items]
            out[fill[c] + place] = items
            np.add(fill, added, out=fill)

    for c in symbols.tolist():
        at = head[c]
        while at < fill[c]:
            block = out[at : fill[c]].copy()
            at = fill[c]
            put(block)
        if own[c]:
            put(sorted_seeds[seed_end[c] - own[c] : seed_end[c]])
    # smaller suffixes, from the back
    back = tail.copy()

    def put_back(after: np.ndarray) -> None:
        before = after - 1
        before = before[before >= 0]
        before = before[smaller[before]]
        if len(before):
            order, added, place = _placed_at(text[before], size)
            items = before[order]
            c = text[items]
            out[back[c] - 1 - place] = items
            np.subtract(back, added, out=back)

    for c in symbols[::-1].tolist():
        at = tail[c]
        while at > back[c]:
            block = out[back[c] : at][::-1].copy()
            at = back[c]
            put_back(block)
        if fill[c] > head[c]:
            put_back(out[head[c] : fill[c]][::-1].copy())
    out[0] = n - 1
    return out


def _by_doubling(text: np.ndarray) -> np.ndarray:
    """Suffix order of a string over many symbols; only suffixes that still tie are ranked again."""
    n = len(text)
    rank = text.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    # rank of a group is the place of its first member
    value = rank[order]
    new = np.concatenate(([True], value[1:] != value[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    while True:
        new = np.concatenate((first[1:] != first[:-1], [True]))
        alone = new & np.concatenate(([True], first[1:] != first[:-1]))
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            return order
        items = order[open_at]
        after = items + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        group = first[open_at]
        again = np.argsort(group * (n + 1) + second + 1, kind="stable")
        items, group, second = items[again], group[again], second[again]
        order[open_at] = items
        start = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        first[open_at] = np.maximum.accumulate(np.where(start, open_at, 0))
        rank[items] = first[open_at]
        step *= 2


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Suffix order of symbols 0..size-1, whose last symbol is 0 and occurs once."""
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1].copy()
    if size > MANY_NAMES:
        return _by_doubling(text)
    # classify: a suffix is smaller than the next one by its first differing neighbour
    ascends = np.sign(np.diff(text.astype(np.int32))).astype(np.int8)
    at = np.where(ascends != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.empty(n, bool)
    smaller[:-1] = ascends[np.minimum(nearest, n - 2)] > 0
    smaller[-1] = True
    leftmost = smaller.copy()
    leftmost[0] = False
    leftmost[1:] &= ~smaller[:-1]
    seeds = np.flatnonzero(leftmost)
    rough = _induced(text, smaller, seeds, size)
    ordered = rough[leftmost[rough]]
    # name the substrings up to and including the next leftmost-smaller position
    number = np.cumsum(leftmost) - 1
    length = np.append(np.diff(seeds) + 1, 1)[number[ordered]]
    same = length[1:] == length[:-1]
    open_pairs = np.flatnonzero(same)
    offset = 0
    while len(open_pairs):
        x, y = ordered[open_pairs] + offset, ordered[open_pairs + 1] + offset
        equal = text[x] == text[y]
        same[open_pairs[~equal]] = False
        offset += 1
        open_pairs = open_pairs[equal & (length[open_pairs] > offset)]
    names = np.cumsum(np.concatenate(([0], ~same)))
    kinds = int(names[-1]) + 1
    if kinds < len(seeds):
        reduced = np.empty(len(seeds), np.int64)
        reduced[number[ordered]] = names
        ordered = seeds[suffix_array(reduced, kinds)]
    return _induced(text, smaller, ordered, size)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the common prefix with the suffix just before it in order, and that suffix."""
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    own = np.arange(n)
    free = (before < 1) | (own == 0)
    free |= text[own - 1] != text[np.maximum(before - 1, 0)]
    at = np.flatnonzero(free & (before >= 0))
    four = np.zeros(n + 4, np.uint64)
    for k in range(min(4, n)):
        four[: n - k] |= text[k:].astype(np.uint64) << np.uint64(16 * k)
    length = np.zeros(n, np.int64)
    x, y, offset = at, before[at], 0
    while len(x):
        far = np.maximum(x, y) + offset
        differ = (four[np.minimum(x + offset, n)] ^ four[np.minimum(y + offset, n)])
        equal = (differ == 0) & (far + 4 <= n)
        done = ~equal
        low = differ[done]
        short = np.where(low & np.uint64(0xFFFF), 0, np.where(low & np.uint64(0xFFFF0000), 1, np.where(low & np.uint64(0xFFFF00000000), 2, 3)))
        length[x[done]] = offset + np.where(low == 0, 0, short)
        x, y = x[equal], y[equal]
        offset += 4
    anchor = np.maximum.accumulate(np.where(free, own, 0))
    return np.maximum(length[anchor] - (own - anchor), 0), before


def byte_runs(texts: list[bytes], docs: np.ndarray, rows: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> Runs:
    """The runs of byte windows with one minimiser in each text."""
    most = 1 << PLACE_BITS
    if sum(map(len, texts)) < most:
        return _byte_runs(texts, docs, rows, np.zeros(len(texts), np.int64), window, gram)
    # a very long text goes in slices that overlap by less than a window; cuts between runs are free
    step = most - window
    parts = [(i, a) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - window + 1), step)]
    done = [_byte_runs([texts[i][a : a + most - 1]], docs[[i]], rows[[i]], np.array([a]), window, gram) for i, a in parts]
    return Runs(*(np.concatenate([getattr(r, k) for r in done]) for k in COLUMNS), [s for r in done for s in r.strings])


def _byte_runs(texts: list[bytes], docs: np.ndarray, rows: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Runs:
    data = b"".join(texts)
    last = len(data) - window + 1
    if last < 1:
        return Runs(*[np.empty(0, np.int64)] * 5, [])
    sums = prefix_hash(np.frombuffer(data, np.uint8))
    at = np.arange(len(data) - gram + 1)
    bits = np.uint64(PLACE_BITS)
    # the hash above, the place below: the minimum is the leftmost place of the smallest hash
    keys = mix(slice_hash(sums, at, at + gram)) >> bits << bits | at.astype(np.uint64)
    best = sliding_min(keys, window - gram + 1)
    low = best >> bits
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(sizes) - sizes
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    inside = text_of[:last] == text_of[window - 1 :]
    fresh = np.concatenate(([True], (low[1:] != low[:-1]) | (inside[1:] != inside[:-1]) | (text_of[1:last] != text_of[: last - 1])))
    begin = np.flatnonzero(fresh)
    stop = np.append(begin[1:], last)
    valid = inside[begin]
    begin, stop = begin[valid], stop[valid]
    of = text_of[begin]
    ends = (stop + window - 1).tolist()
    strings = [data[a:b] for a, b in zip(begin.tolist(), ends)]
    place = (best[begin] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64).tolist()
    # equal windows in one run hold the gram at different places
    again = np.fromiter((data.find(data[p : p + gram], p + 1, e) >= 0 for p, e in zip(place, ends)), bool, len(place))
    return Runs(mix(low[begin]).view(np.int64), docs[of], rows[of], begin - base[of] + offsets[of], again.astype(np.int64), strings)


def repeated(runs: Runs, window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """(run, from, to) of bytes whose windows also start elsewhere."""
    # of equal runs two show the suffix array all that more would
    index: dict[bytes, list[int]] = {}
    for i, s in enumerate(runs.strings):
        index.setdefault(s, []).append(i)
    owners = [own[:2] for own in index.values()]
    parts = [s for s, own in zip(index, owners) for _ in own]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    text = np.full(int(sizes.sum()) + len(parts) + 1, END_OF_RUN, np.uint16)
    ends = np.cumsum(sizes + 1)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = inside[-1] = False
    text[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 2
    text[-1] = END_OF_ALL
    shared, before = common_prefixes(text, suffix_array(text, 258))
    flags = shared >= window
    flags[before[flags]] = True
    at = 0
    for own in index.values():
        size = len(runs.strings[own[0]])
        found = intervals(flags[at : at + size - window + 1], window)
        for i in own:
            for x, y in found:
                yield i, int(runs.start[i]) + x, int(runs.start[i]) + y
        at += (size + 1) * min(2, len(own))


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs plus n_bytes, n_removed, n_spans (long), spans (removed byte ranges) and kept (binary, the other bytes).

    Texts are their UTF-8 bytes, a null text is empty. Every row counts, repeated rows and rows
    without id included, so that each of two equal long rows loses its bytes. Columns of these names
    are replaced.
    """
    docs = keyed(docs, id_col, text_col)
    gram = min(GRAM, window)
    texts = docs.where(F.octet_length(F.col(f"`{text_col}`")) >= window).select("__doc", "__row", F.col(f"`{text_col}`").alias("__text"))
    shards = shards_for(texts)

    def cut_runs(group, ids, rows):
        return byte_runs(group, ids, rows, window, gram)

    def removed(runs):
        return repeated(runs, window)

    spans = spans_of_shards(to_shards(texts, cut_runs, shards), removed)
    found = with_spans(docs, spans, ("n_bytes", "n_removed", "n_spans", "spans", "kept"))
    own = [c for c in found.columns if c not in ("__doc", "__row", "__spans")]
    inner = found.select(*[F.col(f"`{c}`") for c in own], "__spans").toDF(*[f"c{i}" for i in range(len(own) + 1)])
    at, n = own.index(text_col), len(own)
    span = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))
    long = T.LongType()
    added = T.StructType([T.StructField("n_bytes", long), T.StructField("n_removed", long), T.StructField("n_spans", long), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    schema = T.StructType([*(T.StructField(f"c{i}", inner.schema[i].dataType) for i in range(n)), *(T.StructField(f"a{i}", f.dataType) for i, f in enumerate(added.fields))])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.binary())
        for batch in batches:
            out: list[tuple] = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist()):
                data = (text or "").encode()
                cut = joined([(s["__from"], s["__to"]) for s in spans or []])
                edges = [0, *(e for c in cut for e in c), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), len(cut), [{"from": x, "to": y} for x, y in cut], kept))
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(c, t) for c, t in zip(columns, kinds))], schema.names)

    return mapped(inner, finish, schema).toDF(*own, *added.names)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and the digest of the bytes that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", sha256_hex("kept").alias("kept_sha256"))


#: The query in DuckDB: every 400-byte string by its digest, the runs that repeated ones cover, and the bytes between them.
OP2_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, unnest(range(0, octet_length(b) - 399)) AS i, b FROM d WHERE octet_length(b) >= 400),
h AS (SELECT r, i, md5(b[i + 1:i + 400]) AS k FROM w),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM h) WHERE n > 1),
g AS (SELECT r, i, sum(f) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS f FROM s)),
p AS (SELECT r, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY r, g),
t AS (SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before, lead(a) OVER (PARTITION BY r ORDER BY a) IS NULL AS last FROM p),
o AS (SELECT t.r, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(hex(b[before + 1:a]) || CASE WHEN last THEN hex(b[z + 1:octet_length(b)]) ELSE '' END, '' ORDER BY a) AS x FROM t JOIN d ON d.r = t.r GROUP BY t.r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, CASE WHEN o.r IS NULL THEN sha256(b) ELSE sha256(unhex(x)) END AS kept_sha256 FROM d LEFT JOIN o ON d.r = o.r"""
