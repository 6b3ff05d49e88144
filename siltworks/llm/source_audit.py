"""How far the sources of each language diverge in their words.

One pass counts each group's terms, a group being one (lang, source). A task sends what it counted in
packed blobs, one for each chunk of a language's vocabulary (terms by hash), and the task of a chunk merges them,
keeps the terms in enough documents, numbers them, and writes one packed count vector for each group.

Pairs of groups are compared in two dimensions of blocks: a group's vectors are replicated to every
task that pairs its block of groups with another block. A task works through successive chunks of the
vocabulary, with one chunk of both blocks in memory, and adds up the submatrix of its pairs.
Slabs of chunks go to different tasks, whose submatrices are added.

All arithmetic is in whole numbers. A share is 1 + floor(UNIT * (count + 5) / (N + 5 * V)).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, mapped

#: ASCII letters and everything beyond ASCII, in UTF-8.
TERM = re.compile(rb"[a-z\x80-\xff]+")
UNIT, PRIOR = 10**9, 5
MIN_DOCS, TOP = 30, 50
#: Chunks of a task, and groups of a block.
SLAB, GROUPS = 16, 64
#: Bytes of the terms that a counting task holds before it sends them on, and partial counts that a merging task holds; they bound memory, not results.
HELD, ROWS = 96 << 20, 2_000_000
#: Bytes of a text whose terms are listed at once.
PIECE = 4 << 20
END = re.compile(rb"[^a-z\x80-\xff]")


def terms_of(text: str) -> Counter:
    """How often each term occurs in a text."""
    # bytes.lower changes A to Z alone
    data, out, at = text.encode().lower(), Counter(), 0
    while at < len(data):
        end = END.search(data, at + PIECE)
        stop = end.start() if end else len(data)
        out.update(TERM.findall(data, at, stop))
        at = stop
    return out


def chunks_for(documents: int) -> int:
    """Chunks of a language's vocabulary, which grows about as the root of the corpus does."""
    return ceil(sqrt(documents) / 4) or 1


COUNTS = pa.schema([("term", pa.binary()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def counted(docs: DataFrame, chunks: int) -> DataFrame:
    """(lang, chunk, blob) of docs (lang, source, text): a blob holds occurrences, and documents, of terms by source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, tuple[Counter, Counter]]] = {}
        size = 0

        def emit():
            for lang, sources in held.items():
                terms = [t for n, _ in sources.values() for t in n]
                if not terms:
                    continue
                chunk = np.fromiter((zlib.crc32(t) % chunks for t in terms), np.int32, len(terms))
                order = np.argsort(chunk, kind="stable")
                columns = [
                    pa.array(terms, pa.binary()), pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(sources), dtype=np.int32), [len(n) for n, _ in sources.values()]), pa.array(list(sources), pa.string())).cast(pa.string()),
                    pa.array([v for n, _ in sources.values() for v in n.values()], pa.int64()), pa.array([d[t] for n, d in sources.values() for t in n], pa.int64())]
                whole = pa.RecordBatch.from_arrays(columns, schema=COUNTS).take(pa.array(order))
                edges = np.flatnonzero(np.diff(chunk[order], prepend=-1, append=-1))
                for a, b in zip(edges.tolist(), edges[1:].tolist()):
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array(chunk[order[a : a + 1]]), pa.array([_blob(whole.slice(a, b - a))], pa.binary())], ["lang", "chunk", "blob"])

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = terms_of(text)
                n, d = held.setdefault(lang, {}).setdefault(source, (Counter(), Counter()))
                before = len(n)
                n.update(own)
                d.update(own.keys())
                # a new term takes its bytes and about 250 bytes of tables
                size += 250 * (len(n) - before) + (sum(map(len, own)) if len(n) > before else 0)
                if size > HELD:
                    yield from emit()
                    held.clear()
                    size = 0
        yield from emit()

    return mapped(docs.select("lang", "source", "text"), run, "lang string, chunk int, blob binary")


PACKED = pa.schema([
    ("lang", pa.string()), ("chunk", pa.int32()), ("source", pa.string()), ("size", pa.int32()), ("own", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("words", pa.list_(pa.string()))])


def packed(blobs: DataFrame, min_docs: int) -> DataFrame:
    """Count vectors (lang, chunk, source, size, own, at, n, words) of the kept terms.

    Each chunk has a row of a null source with its words in order and the language's counts; a group's row has the
    places and counts of the terms it holds. size is the chunk's number of terms, own the sum of n.
    """

    def merged(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(["term", "source"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(COUNTS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for (lang, chunk), own in groupby(rows, key=lambda r: r[:2]):
            held, total = [], 0
            for _, _, blob in own:
                held.append(pa.ipc.open_stream(blob).read_all())
                total += held[-1].num_rows
                if total > ROWS:
                    held = [merged(held)]
                    total = held[0].num_rows // 2
            counts = merged(held)
            terms = counts.group_by("term").aggregate([("n", "sum"), ("docs", "sum")])
            terms = terms.filter(pc.greater_equal(terms["docs_sum"], min_docs)).sort_by("term")
            size = terms.num_rows
            if not size:
                continue
            at = pc.index_in(counts["term"], value_set=terms["term"].combine_chunks())
            counts = counts.append_column("at", at).filter(pc.is_valid(at)).sort_by([("source", "ascending"), ("at", "ascending")])
            source = counts["source"].combine_chunks().dictionary_encode()
            n, at = counts["n"].to_numpy(), counts["at"].to_numpy()
            yield pa.RecordBatch.from_pylist([{"lang": lang, "chunk": chunk, "size": size, "own": int(n.sum()), "n": terms["n_sum"].to_pylist(), "words": terms["term"].cast(pa.string()).to_pylist()}], PACKED)
            edges = np.flatnonzero(np.diff(source.indices.to_numpy(), prepend=-1, append=-1))
            for a, b in zip(edges.tolist(), edges[1:].tolist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang], pa.string()), pa.array([chunk], pa.int32()), counts["source"].slice(a, 1).combine_chunks(), pa.array([size], pa.int32()), pa.array([int(n[a:b].sum())], pa.int64()),
                     pa.array([at[a:b]], pa.list_(pa.int32())), pa.array([n[a:b]], pa.list_(pa.int64())), pa.array([None], pa.list_(pa.string()))], schema=PACKED)

    dealt = blobs.repartition("lang", "chunk").sortWithinPartitions("lang", "chunk")
    return mapped(dealt, run, "lang string, chunk int, source string, size int, own long, at array<int>, n array<long>, words array<string>")


def shares(count: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)) in whole numbers, digit by digit in base 1000."""
    rest, below = count + PRIOR, total + PRIOR * terms
    out = rest // below
    rest = rest % below
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


def excess(vectors: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value): each group's best terms of each chunk by what their share exceeds the language's.

    vectors has the columns of packed() with total, the group's or the language's count over all chunks, and terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = below = None
        for batch in batches:
            for k in range(batch.num_rows):
                lang, source, total, terms = (batch.column(i)[k].as_py() for i in range(4))
                n = batch.column(5)[k].values.to_numpy()
                share = shares(n, np.int64(total), np.int64(terms))
                if source is None:
                    words, below = batch.column(6)[k].values, share
                    continue
                at = batch.column(4)[k].values.to_numpy()
                value = share - below[at]
                best = np.lexsort((at, -value))[:top]
                best = best[value[best] > 0]
                if len(best):
                    m = len(best)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * m), pa.array([source] * m), words.take(pa.array(at[best])), pa.array(value[best])], ["lang", "source", "item", "value"])

    ordered = vectors.sortWithinPartitions("lang", "chunk", "source")
    return mapped(ordered.select("lang", "source", "total", "terms", "at", "n", "words"), run, "lang string, source string, item string, value long")


TILE = ["lang", "p", "q", "slab"]


def tiles(roster: DataFrame, vectors: DataFrame) -> DataFrame:
    """(lang, source, item, value): each task's part of the distances between the sources of a language, both ways.

    roster has (lang, source, block, blocks, total, terms) of every group; vectors the rows of packed() with block and blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for (lang, p, q, _), tile in groupby(rows, key=lambda r: r[:4]):
            order: dict[str, int] = {}
            for chunk, held in groupby(tile, key=lambda r: r[4]):
                if chunk < 0:
                    groups = list(held)
                    order = {r[5]: n for n, r in enumerate(groups)}
                    total, terms = np.array([r[8] for r in groups])[:, None], np.int64(groups[0][9])
                    side = np.array([r[6] == p for r in groups])
                    first, second = np.flatnonzero(side), np.flatnonzero(side if p == q else ~side)
                    sums = np.zeros((len(first), len(second)), np.int64)
                    continue
                if not order:
                    break  # no group has a hash of these blocks
                # the chunk's own row comes first
                count = np.zeros((len(order), next(held)[7]), np.int64)
                for r in held:
                    count[order[r[5]], r[10]] = r[11]
                share = shares(count, total, terms)
                other = share[second]
                for n, i in enumerate(first.tolist()):
                    sums[n] += np.abs(other - share[i]).sum(1)
            if not order:
                continue
            names = list(order)
            got = [(lang, names[i], names[j], int(sums[n, m])) for n, i in enumerate(first.tolist()) for m, j in enumerate(second.tolist()) if i != j]
            if p != q:
                got += [(a, c, b, v) for a, b, c, v in got]
            for lo in range(0, len(got), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got[lo : lo + 10_000])], ["lang", "source", "item", "value"])

    slab = F.expr(f"chunk div {SLAB}").cast("int").alias("slab")
    slabs = vectors.where("source is null").select("lang", slab).distinct()
    columns = ["lang", "slab", "chunk", "source", "block", "size", "total", "terms", "at", "n"]
    listed = roster.join(slabs, "lang").selectExpr("lang", "slab", "-1 as chunk", "source", "block", "0 as size", "total", "terms", "cast(null as array<int>) as at", "cast(null as array<long>) as n", "blocks")
    # a chunk's own row goes to every tile, without its counts
    own = vectors.selectExpr("lang", f"cast(chunk div {SLAB} as int) as slab", "chunk", "source", "block", "size", "0L as total", "0L as terms", "at", "if(source is null, null, n) as n", "blocks")
    cells = listed.unionByName(own).withColumn("own", F.explode(F.expr("if(block is null, sequence(0, blocks - 1), array(block))")))
    cells = cells.withColumn("other", F.explode(F.expr("if(block is null, sequence(own, blocks - 1), sequence(0, blocks - 1))")))
    cells = cells.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
    dealt = cells.repartition(*TILE).sortWithinPartitions(*TILE, "chunk", "source")
    return mapped(dealt.select("lang", "p", "q", "slab", "chunk", "source", "block", "size", "total", "terms", "at", "n"), run, "lang string, source string, item string, value long")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, chunks: int | None = None, block: int = GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text).

    Null texts, langs and sources are empty strings; repeated rows are documents of their own; other
    columns are ignored. A language keeps the terms (only A to Z lower-cased) in at least min_docs of
    its documents. Part "pair" gives every other source of the language, with the summed difference of
    shares over all kept terms (0 without any); part "term" the `top` kept terms of the group whose share exceeds
    the language's, with the excess. Ranks run from 1 by value descending and item ascending.
    """
    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    vectors = cut(packed(counted(texts, chunks or chunks_for(docs.count())), min_docs))
    groups = cut(texts.select("lang", "source").distinct().withColumn("x", F.lit(1)))
    few = groups.count() <= 1_000_000

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    langs = vectors.where("source is null").groupBy("lang").agg(F.sum("size").alias("terms"), F.sum("own").alias("all"))
    own = vectors.where("source is not null").groupBy("lang", "source").agg(F.sum("own").alias("own"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    roster = groups.drop("x").join(small(blocks), "lang").join(small(langs), "lang", "left").join(small(own), ["lang", "source"], "left")
    roster = cut(roster.select("lang", "source", F.pmod(F.xxhash64("source"), "blocks").cast("int").alias("block"), "blocks", F.coalesce("own", F.lit(0)).alias("total"), "terms", "all"))
    known = vectors.where("source is not null").join(small(roster.drop("all")), ["lang", "source"])
    heads = vectors.where("source is null").join(small(langs), "lang").join(small(blocks), "lang").withColumns({"total": F.col("all"), "block": F.lit(None).cast("int")})
    known = known.unionByName(heads.drop("all"))
    # a chunk's rows must lie together again, as a union has the partitions of both sides
    words = excess(known.repartition("lang", "chunk"), top).selectExpr("lang", "source", "'term' as part", "item", "value")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    words = words.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    pairs = tiles(roster.where("terms is not null").drop("all"), known).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = roster.where("terms is null")
    none = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("bigint"))
    pairs = pairs.unionByName(none).selectExpr("lang", "source", "'pair' as part", "item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(words)


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group: all other sources of its language by divergence, and its 50 terms above the language."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The query in DuckDB.
OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gk AS (SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n, k.n AS ln FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
gn AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS n FROM gk GROUP BY ALL),
p AS (SELECT lang, source, term, gk.n, 1 + (1000000000 * (gk.n + 5)) // (gn.n + 5 * l.v) AS p, 1 + (1000000000 * (gk.ln + 5)) // (CAST(l.n AS HUGEINT) + 5 * l.v) AS q FROM gk JOIN gn USING (lang, source) JOIN l USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x) WHERE part = 'pair' OR rank <= 50"""
