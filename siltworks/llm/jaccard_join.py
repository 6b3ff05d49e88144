"""N-gram Jaccard join: connected classes of documents whose shingle sets are similar.

Equal sets fold into one node first. A node is listed under its rarest shingles, as many as a
similar set cannot all miss, so that every similar pair meets under some shingle. Shingles that many
documents share come last in that order, whatever order is used the join stays exact.

Under a shingle, nodes are points: the counts of their shingles in GROUPS hash groups. The points
are packed into an R-tree whose boxes hold coordinate maxima. The overlap of two sets is at most the
sum of the smaller counts, for boxes as for points, so pairs of boxes and then of points below the
needed overlap are dropped. The pairs that are left are verified on the whole texts.

Dense classes are not paired off: nodes are first compared with one pivot per shingle and size
class, and only nodes of different classes are joined afterwards. Crowded shingles are dealt out as
pairs of blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, mapped
from .shards import CHUNK, keyed, mix, prefix_hash, slice_hash

#: Hash groups of the points in the tree, and of the finer points that its pairs are bounded by again.
GROUPS, FINE = 128, 1024
#: Documents from which a shingle counts as common, and the most common ones that are remembered.
COMMON, MOST_COMMON = 100, 200_000
LEAF, BLOCK = 16, 2048
#: Ids of at most this number (8 MB) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted shingle hashes of each text: words in lower case (A-Z only), `size` at a time."""
    split = [t.lower().split() for t in texts]
    data = b" ".join(b" ".join(w) for w in split if w)
    flat = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero(flat == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(flat))
    words = mix(slice_hash(prefix_hash(flat), starts, ends))
    out, at = [], 0
    for w in split:
        n = len(w)
        own = words[at : at + n]
        at += n
        k = min(size, n)
        h = own[: n - k + 1] if n else own[:0]
        for i in range(1, k):
            h = mix(h * np.uint64(3)) + own[i : n - k + 1 + i]
        h = np.sort(mix(h))
        out.append(h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h)
    return out


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of up to CHUNK bytes at a time."""
    at = 0
    while at < batch.num_rows:
        first, group, total = at, [], 0
        while at < batch.num_rows and total < CHUNK:
            group.append((batch.column(column)[at].as_py() or "").encode())
            total += len(group[-1])
            at += 1
        yield first, group


def _common_shingles(docs: DataFrame, size: int) -> dict[int, int]:
    """The commonest shingles and their counts, from all documents.

    A task reports a shingle once it has met it twice, so that a shingle in more than COMMON
    documents plus one per task is never overlooked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, group in _chunks(batch, 0):
                values, counts = np.unique(np.concatenate(shingle_sets(group, size)), return_counts=True)
                often = counts > 1
                yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["s", "n"])

    counted = mapped(docs.select("__text"), run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    top = counted.orderBy(F.desc("n"), "s").limit(MOST_COMMON).collect()
    return {r.s: r.n for r in top}


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """(__doc, __row, n, node, counts, fine) of every document."""

    def packed(h: np.ndarray, groups: int) -> bytes:
        # counts above 255 keep the rest in n, see _excess
        return np.minimum(np.bincount((h % np.uint64(groups)).astype(np.int64), minlength=groups), 255).astype(np.uint8).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for first, group in _chunks(batch, 2):
                sets = shingle_sets(group, size)
                counts = [packed(h, GROUPS) for h in sets]
                fine = [packer.compress(packed(h, FINE)) for h in sets]
                rows = slice(first, first + len(group))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[rows], batch.column(1)[rows], pa.array([len(h) for h in sets], pa.int64()),
                        pa.array([_node(h) for h in sets], pa.int64()), pa.array(counts, pa.binary()), pa.array(fine, pa.binary()),
                    ],
                    ["__doc", "__row", "n", "node", "counts", "fine"],
                )

    return mapped(docs.select("__doc", "__row", "__text"), run, "__doc long, __row long, n long, node long, counts binary, fine binary")


def _node(h: np.ndarray) -> int:
    """The name of a set."""
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def _excess(n: np.ndarray, points: np.ndarray) -> np.ndarray:
    """What the capped counts of each set leave out; one more coordinate of its point."""
    return n - points.sum(1, dtype=np.int64)


def _listed(docs: DataFrame, size: int, num: int, den: int, common: dict[int, int]) -> DataFrame:
    """(key, node, n): each set under its rarest shingles, once a task."""
    hot = np.array(sorted(common), np.int64)
    weight = np.array([common[h] for h in hot.tolist()], np.int64)

    def listed(h: np.ndarray) -> np.ndarray:
        n = len(h)
        most = n - (n * num + den - 1) // den + 1
        s = h.view(np.int64)
        if len(hot):
            place = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
            rank = np.where(hot[place] == s, weight[place], 0)
            if rank.any():
                # by the unsigned hashes, the order of the sets without a common shingle
                s = s[np.lexsort((h, rank))]
        return s[:most]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, group in _chunks(batch, 0):
                keys, nodes, sizes = [], [], []
                for h in shingle_sets(group, size):
                    node = _node(h)
                    if len(h) and node not in seen:
                        if len(seen) < 1_000_000:
                            seen.add(node)
                        keys.append(listed(h))
                        nodes.append(node)
                        sizes.append(len(h))
                if keys:
                    times = [len(k) for k in keys]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(nodes), times)), pa.array(np.repeat(np.array(sizes), times))], ["key", "node", "n"])

    return mapped(docs.select("__text"), run, "key long, node long, n long")


def _shared(listed: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of listed that share their key with another set of similar size.

    In the order of sizes under a key it is enough to look at the neighbours.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            key, node, n = (c.to_numpy() for c in batch.columns)
            met = False
            if last is not None:
                key, node, n = (np.concatenate(([x], c)) for x, c in zip(last, (key, node, n)))
                met = last[3]
            own = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
            key, node, n = key[own], node[own], n[own]
            fits = (key[1:] == key[:-1]) & (n[:-1] * den >= n[1:] * num)
            keep = np.concatenate(([met], fits)) | np.concatenate((fits, [False]))
            last = (key[-1], node[-1], n[-1], bool(keep[-1]))
            keep[-1] = False
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (key, node, n)], ["key", "node", "n"])
        if last is not None and last[3]:
            yield pa.RecordBatch.from_arrays([pa.array(np.array([c])) for c in last[:3]], ["key", "node", "n"])

    return mapped(listed.repartition("key").sortWithinPartitions("key", "n", "node"), run, listed.schema)


def _bounded(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose summed coordinate minima allow the similarity, by their fine points."""
    fine = points.select("node", "n", "fine")
    both = pairs.join(fine.toDF("a", "na", "fa"), "a").join(fine.toDF("b", "nb", "fb"), "b").select("a", "b", "na", "fa", "nb", "fb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                b = batch.slice(lo, 4096)
                x, y = (np.frombuffer(b"".join(map(reader.decompress, b.column(i).to_pylist())), np.uint8).reshape(-1, FINE) for i in (3, 5))
                nx, ny = b.column(2).to_numpy(), b.column(4).to_numpy()
                overlap = np.minimum(x, y).sum(1, dtype=np.int64) + np.minimum(_excess(nx, x), _excess(ny, y))
                mask = pa.array(overlap * (den + num) >= num * (nx + ny), pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    return mapped(both, run, "a long, b long")


def _chosen(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """The rows of df whose key is in ids; ids are broadcast only if they are few."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, on, "left_semi")


def box_join(n: np.ndarray, group: np.ndarray, counts: np.ndarray, side: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points of different groups whose bounded overlap allows the similarity.

    side is 0 for points that meet only points of side 1, 1 the other way round, 2 for all. counts
    are capped counts (uint8). The tree has two levels: leaves of LEAF points packed by group and
    size, and their boxes.
    """
    more = _excess(n, counts)

    def points(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        overlap = np.minimum(counts[v][:, None], counts[w][None]).sum(2, dtype=np.int64) + np.minimum(more[v][:, None], more[w][None])
        # intersection * den >= union * num, so intersection * (den + num) >= num * (both sizes)
        ok = overlap * (den + num) >= num * (n[v][:, None] + n[w][None])
        ok &= (group[v][:, None] != group[w][None]) & ((side[v][:, None] == 2) | (side[v][:, None] != side[w][None]))
        return np.nonzero(np.triu(ok, 1) if v is w else ok)

    order = np.lexsort((n, group, side))
    leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
    if len(leaves) == 1:
        a, b = points(order, order)
        if len(a):
            yield order[a], order[b]
        return
    top = np.array([counts[v].max(0) for v in leaves])
    most = np.array([more[v].max() for v in leaves])
    low, high = np.array([n[v].min() for v in leaves]), np.array([n[v].max() for v in leaves])
    only = np.array([group[v[0]] for v in leaves])
    uniform = np.array([(group[v] == group[v[0]]).all() for v in leaves])
    for i, v in enumerate(leaves):
        rest = np.arange(i, len(leaves))
        bound = np.minimum(top[i], top[rest]).sum(1, dtype=np.int64) + np.minimum(most[i], most[rest])
        fits = bound * (den + num) >= num * (low[i] + low[rest])
        fits &= (high[i] * den >= low[rest] * num) & (high[rest] * den >= low[i] * num)
        fits &= ~(uniform[i] & uniform[rest] & (only[i] == only[rest]))
        for j in rest[fits].tolist():
            w = leaves[j]
            a, b = points(v, w)
            if len(a):
                yield v[a], w[b]


def _candidates(members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) nodes of different groups under one key that the R-tree leaves; members has key, node, n, g, counts."""
    crowd = members.groupBy("key").agg(F.count("*").alias("m"), F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 <> g1")
    crowd = crowd.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(crowd, "key").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "n", "g", "counts",
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for _, own in groupby(rows, key=lambda r: r[:3]):
            _, _, _, node, n, g, counts, side = zip(*own)
            if len(set(g)) < 2:
                continue
            nodes = np.array(node)
            points = np.frombuffer(b"".join(counts), np.uint8).reshape(-1, GROUPS)
            for a, b in box_join(np.array(n), np.array(g), points, np.array(side), num, den):
                x, y = nodes[a], nodes[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    keyed_rows = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return mapped(keyed_rows, run, "a long, b long").distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs that are similar, by their whole texts."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    places = cut(_chosen(nodes, wanted, ["node"]).select("node", "__doc", "__row"))
    few = places.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(places) if few else places, ["__doc", "__row"]).select("node", "__text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packer.compress(t.encode()) for t in b.column(1).to_pylist()], pa.binary())], ["node", "packed"])

    small = cut(mapped(texts, packed, "node long, packed binary"))
    both = pairs.join(small.toDF("a", "pa"), "a").join(small.toDF("b", "pb"), "b").select("a", "b", "pa", "pb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        held: dict[bytes, np.ndarray] = {}

        def of(blob: bytes) -> np.ndarray:
            got = held.get(blob)
            if got is None:
                if len(held) >= 64:
                    held.clear()
                got = held[blob] = shingle_sets([reader.decompress(blob)], size)[0]
            return got

        for b in batches:
            keep = []
            for pa_, pb in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = of(pa_), of(pb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * den >= num * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    return mapped(both, run, "a long, b long").distinct()


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per row of docs: (id_col, __row, n_shingles, component_id), __row being a hash of the text.

    Two documents link when den * intersection >= num * union of their shingle sets; a text of fewer
    than size words has one shingle, all its words, and a text without words or a null one has none
    and links with nothing. component_id is the smallest id reachable by links; rows without an id
    take part, and have a null component_id if they reach no id. Repeated rows are linked.
    """
    source = keyed(docs.select(id_col, text_col), id_col, text_col)
    source = source.select("__doc", "__row", F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    signed = cut(_signed(source, size))
    full = signed.where("n > 0")
    nodes = full.groupBy("node").agg(F.min(F.struct("__doc", "__row")).alias("first")).select("node", "first.*")
    crowd = cut(_shared(_listed(source, size, num, den, _common_shingles(source, size)), num, den))
    classed = crowd.withColumn("k", F.floor(F.log(F.col("n")) / log(den / num)))
    pivots = classed.groupBy("key", "k").agg(F.min(F.struct("node", "n")).alias("p")).select("key", "k", F.col("p.node").alias("a"), F.col("p.n").alias("na"))
    stars = classed.join(pivots, ["key", "k"]).where(f"a <> node and least(n, na) * {den} >= greatest(n, na) * {num}")
    points = _chosen(full, crowd.select("node").distinct(), ["node"]).select("node", "n", "counts", "fine")
    points = cut(points.dropDuplicates(["node"]))
    stars = cut(_bounded(stars.select("a", F.col("node").alias("b")).distinct(), points, num, den))
    found = cut(_verified(stars, nodes, source, size, num, den))
    groups = connected_components(found)
    members = cut(crowd.join(groups.withColumnRenamed("component", "g"), "node", "left").withColumn("g", F.coalesce("g", "node")))
    mixed = members.groupBy("key").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x <> y").select("key")
    members = members.join(mixed, "key").join(points.select("node", "counts"), "node").select("key", "node", "n", "g", "counts")
    pairs = cut(_bounded(_candidates(members, num, den), points, num, den).join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    rest = cut(_verified(pairs, nodes, source, size, num, den))
    if not rest.isEmpty():
        groups = connected_components(found.unionByName(rest))
    placed = full.select("node", "__doc").groupBy("node").agg(F.min(F.when(F.col("__doc") > -(1 << 63), F.col("__doc"))).alias("least"))
    placed = placed.join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("g"), "least")
    least = placed.groupBy("g").agg(F.min("least").alias("component"))
    named = placed.join(least, "g").select("node", "component")
    out = signed.select("__doc", "__row", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    own = F.when(F.col("__doc") > -(1 << 63), F.col("__doc"))
    return out.select(own.alias(id_col), "__row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(own).alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_classes(docs).select("doc_id", "n_shingles", "component_id")


#: The query in DuckDB: all pairs that share a shingle, their sets' sizes, and what links reach.
OP7_SQL = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
t(r, z) AS (SELECT r, r FROM d UNION SELECT t.r, e.y FROM t JOIN e ON t.z = e.x),
m AS (SELECT t.r, min(d.doc_id) AS c FROM t JOIN d ON t.z = d.r GROUP BY t.r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id FROM d JOIN m USING (r) LEFT JOIN n USING (r)"""
