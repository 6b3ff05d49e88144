"""Substring dedup over word windows by super-k-mers.

The minimiser of a window is the smallest hash of the word triples in it. Consecutive windows that
share a minimiser travel as one packed string (a super-k-mer) to the shard of the minimiser. There
the windows are sorted by a hash of their text and equal neighbours compared in full, which gives
the exact group of every window and the smallest document that holds it. Words covered by a window
that also starts in a document with a smaller id go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, sha256_hex
from .shards import Runs, intervals, joined, keyed, mix, prefix_hash, shards_for, slice_hash, sliding_min, spans_of_shards, to_shards, with_spans

WINDOW, GRAM = 13, 3


def super_kmers(texts: list[bytes], docs: np.ndarray, rows: np.ndarray, window: int = WINDOW) -> Runs:
    """The runs of windows with one minimiser in each text."""
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split])
    data = b" ".join(b" ".join(w) for w in split if w)
    flat = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero(flat == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(flat))
    total = int(counts.sum())
    empty = np.empty(0, np.int64)
    if total < window:
        return Runs(*[empty] * 5, [])
    words = slice_hash(prefix_hash(flat), starts, ends)
    g = GRAM
    grams = words[: total - g + 1].copy()
    for k in range(1, g):
        grams = mix(grams) + words[k : total - g + 1 + k]
    low = sliding_min(mix(grams), window - g + 1)
    text_of = np.repeat(np.arange(len(texts)), counts)
    last = total - window + 1
    inside = text_of[:last] == text_of[window - 1 :]
    fresh = np.concatenate(([True], (low[1:] != low[:-1]) | (inside[1:] != inside[:-1]) | (text_of[1:last] != text_of[: last - 1])))
    begin = np.flatnonzero(fresh)
    stop = np.append(begin[1:], last)
    valid = inside[begin]
    begin, stop = begin[valid], stop[valid]
    base = np.cumsum(counts) - counts
    of = text_of[begin]
    strings = [data[a:b] for a, b in zip(starts[begin].tolist(), ends[stop + window - 2].tolist())]
    return Runs(low[begin].view(np.int64), docs[of], rows[of], begin - base[of], np.zeros(len(of), np.int64), strings)


def repeated(runs: Runs, window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """(run, from, to) in words of the text that also start in a smaller document."""
    data = b" ".join(runs.strings)
    flat = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero(flat == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(flat))
    counts = np.array([s.count(b" ") + 1 for s in runs.strings])
    n_windows = counts - window + 1
    base = np.cumsum(counts) - counts
    first = np.cumsum(n_windows) - n_windows
    run_of = np.repeat(np.arange(len(counts)), n_windows)
    word = np.arange(len(run_of)) - first[run_of] + base[run_of]
    a, b = starts[word], ends[word + window - 1]
    keys = mix(slice_hash(prefix_hash(flat), a, b))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    lead = np.flatnonzero(np.concatenate(([True], ~same)))
    group = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(order))))
    heads = order[lead][group]
    follow = np.flatnonzero(heads != order)
    texts = zip(a[order][follow].tolist(), b[order][follow].tolist(), a[heads][follow].tolist(), b[heads][follow].tolist())
    bad = [n for n, (p, q, r, s) in enumerate(texts) if data[p:q] != data[r:s]]
    if bad:  # different texts under one hash: group by the texts themselves
        hit = np.isin(group, group[follow[bad]])
        names: dict[bytes, int] = {}
        for n in np.flatnonzero(hit).tolist():
            w = order[n]
            group[n] = names.setdefault(data[a[w] : b[w]], len(lead) + len(names))
        again = np.argsort(group, kind="stable")
        order, group = order[again], group[again]
        lead = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        group = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(order))))
    docs = runs.doc[run_of]
    smallest = np.minimum.reduceat(docs[order], lead)
    flags = np.empty(len(order), bool)
    flags[order] = docs[order] > smallest[group]
    for r in np.unique(run_of[flags]).tolist():
        for x, y in intervals(flags[first[r] : first[r] + n_windows[r]], window):
            yield r, int(runs.start[r]) + x, int(runs.start[r]) + y


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs plus n_words, n_removed (long), spans (removed word ranges) and kept (the other words).

    Words are runs of anything but ASCII white space, and kept joins them by one space. A null or
    empty text has no words and an empty kept. Rows without an id neither lose words nor make others
    lose them; rows with equal ids don't affect each other. Columns of these names are replaced.
    """
    docs = keyed(docs, id_col, text_col)
    texts = docs.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    texts = texts.select("__doc", "__row", F.col(f"`{text_col}`").alias("__text"))
    shards = shards_for(texts)

    def cut_runs(group, ids, rows):
        return super_kmers(group, ids, rows, window)

    def removed(runs):
        return repeated(runs, window)

    blobs = to_shards(texts, cut_runs, shards)
    spans = spans_of_shards(blobs, removed)
    found = with_spans(docs, spans, ("n_words", "n_removed", "spans", "kept"))
    own = [c for c in found.columns if c not in ("__doc", "__row", "__spans")]
    inner = found.select(*[F.col(f"`{c}`") for c in own], "__spans").toDF(*[f"c{i}" for i in range(len(own) + 1)])
    at, n = own.index(text_col), len(own)
    span = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))
    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.StringType())])
    schema = T.StructType([*(T.StructField(f"c{i}", inner.schema[i].dataType) for i in range(n)), *(T.StructField(f"a{i}", f.dataType) for i, f in enumerate(added.fields))])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for batch in batches:
            out: list[tuple] = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist()):
                words = (text or "").encode().split()
                cut = joined([(s["__from"], s["__to"]) for s in spans or []])
                kept, last = [], 0
                for x, y in cut:
                    kept += words[last:x]
                    last = y
                kept += words[last:]
                out.append((len(words), len(words) - len(kept), [{"from": x, "to": y} for x, y in cut], b" ".join(kept).decode()))
            columns = zip(*out) if out else ([], [], [], [])
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), kind, pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *arrays], schema.names)

    return mapped(inner, finish, schema).toDF(*own, *added.names)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the digest of the words that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", sha256_hex("kept").alias("kept_sha256"))


#: The query in DuckDB: every window as text, its smallest document, and the words that are left.
OP1_SQL = r"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w) WHERE doc_id IS NOT NULL),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
c AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (k) WHERE doc_id > least),
n AS (SELECT r, count(*) AS n FROM c GROUP BY r),
k AS (SELECT r, string_agg(w[p], ' ' ORDER BY p) AS kept FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM w) ANTI JOIN c USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN n USING (r) LEFT JOIN k USING (r)"""
