"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated at random and split into blocks of about BLOCK_DIMS dimensions. Two vectors
within the squared distance of the threshold differ in some block by no more than that block's
share of it, in proportion to its dimensions. So each block is range-joined under its own budget,
and the union of what the blocks find is verified by the cosine of the vectors as they are.

A group (one label, one length of vector) of at most `rows` vectors meets in one task with all its
blocks. A larger one is cut into stripes of about that many. Stripes meet in rounds: in round d each
stripe meets the one d places further, so that a vector travels twice in a round at most, and the
shuffle of a round goes before the next. In a task each block is cut into leaves by the medians of its
coordinates, and leaves whose boxes are further apart than the block's budget don't meet.

Rotated vectors are whole numbers, small enough that products and sums of doubles are exact. A pair
counts only in the first block within budget.
No pair leaves a task, only each vector's count of links and one edge to its local component.

Equal vectors fold into one before they meet. Dense groups of different vectors are folded by balls:
members of a ball of half the distance of the threshold are linked with each other by the
triangle inequality and need no comparison, so leaves of one ball never meet. Centres of
balls come from a bounded sample of SAMPLE vectors; no result depends on which they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, cut, mapped, tidy

THRESHOLD = 0.93
BLOCK_DIMS = 16
#: Vectors of a stripe, of at most DIMS dimensions; longer ones have fewer to a stripe.
ROWS, DIMS = 16_384, 64
#: Vectors that place balls, all on the driver: at most 16,384, 8 MB of 64 doubles.
SAMPLE = 16_384
#: A ball is worth folding from this share of its group's sample, and this many sampled vectors.
DENSE, DENSE_ROWS = 0.01, 24
#: Balls of one group.
BALLS = 64
#: Vectors of a leaf, leaves that are compared with one at once, and vectors for each partition that stripes are dealt to.
LEAF, LEAVES, DEALT = 512, 4, 2048
#: What single precision may add to a squared distance of unit vectors.
SINGLE = 1e-5
#: What rounding may add to a distance, as a factor of the budget.
SLACK = 1.01


class Space:
    """The rotation of vectors of one length, with its blocks and their budgets."""

    known: dict[tuple[int, float], Space] = {}

    def __init__(self, dims: int, threshold: float):
        # sums of dims products of two such numbers stay below 2 ** 50
        self.scale = float(1 << ((50 - max(dims - 1, 1).bit_length()) // 2))
        q, r = np.linalg.qr(np.random.default_rng(11).standard_normal((dims, dims)))
        self.rotation = np.rint(q * np.sign(np.diag(r)) * self.scale)
        n = max(1, round(dims / BLOCK_DIMS))
        edges = [dims * i // n for i in range(n + 1)]
        self.blocks = [slice(a, b) for a, b in zip(edges, edges[1:])]
        limit = (2 - 2 * threshold) * SLACK + 1e-6
        self.budgets = [limit * (b - a) / dims * self.scale**2 for a, b in zip(edges, edges[1:])]

    @classmethod
    def of(cls, dims: int, threshold: float) -> Space:
        if (dims, threshold) not in cls.known:
            cls.known[dims, threshold] = cls(dims, threshold)
        return cls.known[dims, threshold]

    def rotated(self, unit: np.ndarray) -> np.ndarray:
        return np.rint(np.rint(unit * self.scale) @ self.rotation / self.scale)


def doubles(blobs: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of one length, each scaled by a power of two, and their lengths."""
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x, np.sqrt((x * x).sum(1))


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of i and j; root holds the smallest place of each component."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def leaves(points: np.ndarray, ball: np.ndarray) -> list[np.ndarray]:
    """The places of points in leaves of at most LEAF that are near each other and of one ball, or of none."""
    todo, out = [np.flatnonzero(ball == k) for k in np.unique(ball)], []
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        own = points[at]
        order = np.argpartition(own[:, own.var(0).argmax()], len(at) // 2)
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def near(own: np.ndarray, budget: float, scale: float, ball: np.ndarray, tile: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within the budget in one block, a few more by rounding; own has the block's coordinates.

    If there are two tiles, only vectors of different tiles meet. Members of one ball don't meet.
    """
    y = own / scale
    half = (y * y).sum(1) / 2
    one = np.ones(len(y))
    # left * right is the product less half of both squares, so that one comparison decides
    left, right = np.column_stack((y, -half, one)).astype(np.float32), np.column_stack((y, one, -half)).astype(np.float32)
    least = np.float32(-(budget / scale**2 + SINGLE) / 2)
    apart = tile.any() and not tile.all()
    sides = [np.flatnonzero(tile == t) for t in (0, 1)] if apart else [np.arange(len(y))] * 2
    cut_up = [[side[at] for at in leaves(own[side], ball[side])] for side in (sides if apart else sides[:1])]
    mine, others = cut_up[0], cut_up[-1]
    low, high = (np.array([f(own[at], 0) for at in others]) for f in (np.min, np.max))
    balls = np.array([ball[at[0]] for at in others])
    for n, at in enumerate(mine):
        gap = np.maximum(0, np.maximum(low - own[at].max(0), own[at].min(0) - high))
        meet = ((gap * gap).sum(1) <= budget) & ((balls < 0) | (balls != ball[at[0]]))
        if not apart:
            meet[:n] = False
        reach = np.flatnonzero(meet)
        for k in range(0, len(reach), LEAVES):
            to = np.concatenate([others[j] for j in reach[k : k + LEAVES]])
            hit = left[at] @ right[to].T >= least
            if not apart and reach[k] == n:
                hit[:, : len(at)] &= np.triu(np.ones((len(at), len(at)), bool), 1)
            found = np.flatnonzero(hit)
            if len(found):
                yield at[found // len(to)], to[found % len(to)]


def linked(x: np.ndarray, norm: np.ndarray, mass: np.ndarray, ball: np.ndarray, tile: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the vectors of one group or stripe, or of two stripes, whose tiles are 0 and 1."""
    space = Space.of(x.shape[1], threshold)
    links, root = np.zeros(len(x), np.int64), np.arange(len(x))
    turned = space.rotated(x / norm[:, None])

    def within(a: np.ndarray, b: np.ndarray, block: int) -> np.ndarray:
        return ((turned[a, space.blocks[block]] - turned[b, space.blocks[block]]) ** 2).sum(1) <= space.budgets[block]

    for block, at in enumerate(space.blocks):
        for i, j in near(turned[:, at], space.budgets[block], space.scale, ball, tile):
            for lo in range(0, len(i), 1 << 16):
                a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                hit = within(a, b, block)
                a, b = a[hit], b[hit]
                hit = (x[a] * x[b]).sum(1) / (norm[a] * norm[b]) >= threshold
                a, b = a[hit], b[hit]
                for earlier in range(block):
                    first = ~within(a, b, earlier)
                    a, b = a[first], b[first]
                np.add.at(links, a, mass[b])
                np.add.at(links, b, mass[a])
                merge(root, a, b)
    return links, root


def _nodes(source: DataFrame, kind: str) -> DataFrame:
    """(id, label, key, dims, vec) of the rows whose vector may have links; key names label and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, lists = batch.columns
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy())
            flat = flat.astype(kind) + 0.0  # one zero
            keep, keys, dims, vecs = [], [], [], []
            names = labels.to_pylist()
            for n, (a, b) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist())):
                v = flat[a:b]
                if v.any() and np.isfinite(v).all():
                    vecs.append(v.tobytes())
                    keys.append(hashlib.blake2b(f"{names[n]}:".encode() + vecs[-1], digest_size=16).digest())
                    keep.append(n)
                    dims.append(b - a)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), labels.take(at), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], ["id", "label", "key", "dims", "vec"])

    return mapped(source, run, "id long, label string, key binary, dims int, vec binary")


class Plan:
    """The balls of a large group."""

    def __init__(self, dims: int, sample: list[bytes], kind: str, threshold: float):
        self.balls = np.empty((0, dims))
        if not sample:
            return
        x, norm = doubles(sample, kind)
        unit = x / norm[:, None]
        reach = 2 - 2 * threshold
        free, balls = np.ones(len(unit), bool), []
        # vectors within the threshold of each sampled one, counted in chunks
        crowd = np.concatenate([(unit[lo : lo + 1024] @ unit.T >= threshold).sum(1) for lo in range(0, len(unit), 1024)])
        least = max(DENSE_ROWS, DENSE * len(unit))
        for i in np.argsort(-crowd, kind="stable").tolist():
            if crowd[i] < least or len(balls) == BALLS:
                break
            if free[i]:
                near = unit @ unit[i] >= 1 - reach / 2
                balls.append(unit[near].mean(0))
                free &= ~near
        if balls:
            self.balls = np.array(balls)


def _ball(plan: Plan, unit: np.ndarray, threshold: float) -> np.ndarray:
    """The ball of each vector, -1 for none."""
    if not len(plan.balls):
        return np.full(len(unit), -1)
    # row by row, so that a vector has the same ball in any batch
    square = np.column_stack([((unit - b) ** 2).sum(1) for b in plan.balls])
    first = square.argmin(1)
    # half the distance of the threshold, less what rounding may hide
    return np.where(square[np.arange(len(unit)), first] <= (2 - 2 * threshold) / 4 - 1e-9, first, -1)


def _met(nodes: DataFrame, turn: int) -> DataFrame:
    """The rows of one round under (label, dims, p), p being a stripe; tile is 0 in it and 1 in the stripe `turn` places further that it meets."""
    if not turn:
        return nodes.select("label", "dims", F.col("h").alias("p"), F.lit(0).alias("tile"), "node", "mass", "vec")
    there = nodes.where(f"stripes >= {2 * turn}")
    both = there.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("tile")).withColumn("p", F.expr(f"pmod(h - tile * {turn}, stripes)"))
    # half way round each pair of stripes would meet twice
    return both.where(f"stripes > {2 * turn} or p < {turn}").select("label", "dims", "p", "tile", "node", "mass", "vec")


KEY = ["label", "dims", "p"]


def _links(members: DataFrame, n: int, plans: dict, kind: str, threshold: float) -> DataFrame:
    """(node, peer, n): for each stripe's or pair of stripes' vectors with links, their number and the local component; n vectors in all."""
    shared = members.sparkSession.sparkContext.broadcast(plans)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for key, own in groupby(rows, key=lambda r: r[: len(KEY)]):
            yield key, [r[len(KEY) :] for r in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in groups(batches):
            if len(own) < 2:
                continue
            tile, node, mass, vec = zip(*own)
            x, norm = doubles(list(vec), kind)
            plan = shared.value.get(key[:2])
            ball = _ball(plan, x / norm[:, None], threshold) if plan else np.full(len(x), -1)
            links, root = linked(x, norm, np.array(mass), ball, np.array(tile), threshold)
            some, names = links > 0, np.array(node)
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[root[some]]), pa.array(links[some])], ["node", "peer", "n"])

    # dealt out by number, as little data is much work here
    dealt = members.repartition(min(2000, 1 + n // DEALT), *KEY).sortWithinPartitions(*KEY)
    return mapped(dealt.select(*KEY, "tile", "node", "mass", "vec"), run, "node long, peer long, n long")


def _balls(nodes: DataFrame, plans: dict, kind: str, threshold: float) -> DataFrame:
    """(node, peer, n) of the links inside balls: everyone with everyone."""
    shared = nodes.sparkSession.sparkContext.broadcast(plans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            for n, g in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if g in shared.value:
                    groups.setdefault(g, []).append(n)
            for g, at in groups.items():
                here = batch.take(pa.array(at))
                x, norm = doubles(here.column(4).to_pylist(), kind)
                ball = _ball(shared.value[g], x / norm[:, None], threshold).astype(np.int32)
                mask = pa.array(ball >= 0)
                yield pa.RecordBatch.from_arrays([here.column(i).filter(mask) for i in range(4)] + [pa.array(ball).filter(mask)], ["label", "dims", "node", "mass", "ball"])

    inside = cut(mapped(nodes.select("label", "dims", "node", "mass", "vec"), run, "label string, dims int, node long, mass long, ball int"))
    whole = inside.groupBy("label", "dims", "ball").agg(F.sum("mass").alias("all"), F.min("node").alias("peer"))
    # at most BALLS for each of at most SAMPLE / DENSE_ROWS groups
    return inside.join(F.broadcast(whole), ["label", "dims", "ball"]).select("node", "peer", (F.col("all") - F.col("mass")).alias("n"))


def _few(groups: DataFrame, n: int) -> DataFrame:
    """groups to be broadcast if they are at most a million (about 50 MB), else as they are."""
    return F.broadcast(groups) if n <= 1_000_000 else groups


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, rows: int = ROWS) -> DataFrame:
    """One row per row of vectors: (id_col, n_links, component_id, kept).

    Rows link when their labels are equal and their vectors, of one length, have a cosine of at least
    threshold in double precision. Null labels, and vectors that are null, empty, zero or hold
    null or non-finite components, link with nothing. Repeated rows link with each other. component_id
    is the smallest id reachable by links, the row's own included; rows without an id take part,
    and have a null component_id if they reach no id. kept says whether component_id is the own id
    (false for a null id). Other columns are ignored.
    """
    kind = "f4" if isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType) else "f8"
    vec = F.col(f"`{vec_col}`").cast(f"array<{'float' if kind == 'f4' else 'double'}>")
    source = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), vec.alias("v"))
    able = source.where("label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)")
    named = _nodes(able, kind)
    one = named.groupBy("key").agg(F.first("label").alias("label"), F.first("dims").alias("dims"), F.first("vec").alias("vec"), F.count("*").alias("mass"), F.min("id").alias("least"))
    with tidy(vectors.sparkSession):
        # numbers given here hold, as the table is written before it is read
        nodes = cut(one.withColumn("node", F.monotonically_increasing_id()))
        total = nodes.count()
        large = nodes.groupBy("label", "dims").agg(F.count("*").alias("n"))
        large = large.select("label", "dims", F.expr(f"ceil(n * greatest(dims, {DIMS}) / {DIMS} / {rows})").cast("int").alias("stripes"))
        large = cut(large.where("stripes > 1"))
        n_large, most = large.agg(F.count("*"), F.coalesce(F.max("stripes"), F.lit(1))).first()
        plans = {}
        if n_large:
            sampled = nodes.join(_few(large, n_large), ["label", "dims"], "left_semi")
            sample: dict[tuple, list[bytes]] = {}
            for r in sampled.select("label", "dims", "vec").sample(min(1.0, SAMPLE / total), seed=7).limit(SAMPLE).collect():
                sample.setdefault((r.label, r.dims), []).append(bytes(r.vec))
            plans = {g: Plan(g[1], vecs, kind, threshold) for g, vecs in sample.items()}
            plans = {g: p for g, p in plans.items() if len(p.balls)}
        striped = nodes.join(_few(large, n_large), ["label", "dims"], "left").withColumn("stripes", F.coalesce("stripes", F.lit(1)))
        striped = striped.withColumn("h", F.expr("cast(pmod(xxhash64(node), stripes) as int)"))
        found = cut(_links(_met(striped, 0), total, plans, kind, threshold))
        for turn in range(1, most // 2 + 1):
            found = found.unionByName(cut(_links(_met(striped, turn), 2 * total, plans, kind, threshold)))
        if plans:
            found = found.unionByName(cut(_balls(nodes, plans, kind, threshold)))
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    counted = found.groupBy("node").agg(F.sum("n").alias("n"))
    placed = nodes.select("node", "key", "mass", "least").join(counted, "node", "left").join(groups, "node", "left")
    placed = placed.select("key", "least", (F.coalesce("n", F.lit(0)) + F.col("mass") - 1).alias("n"), F.coalesce("component", "node").alias("g"))
    first = placed.groupBy("g").agg(F.min("least").alias("component"))
    result = placed.join(first, "g").select("key", "n", "component")
    linked_rows = named.select("id", "key").join(result, "key").select("id", "n", "component")
    valid = "label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    alone = source.where(f"not coalesce({valid}, false)").select("id", F.lit(0).cast("bigint").alias("n"), F.col("id").alias("component"))
    out = linked_rows.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: vec_id, n_links, component_id and kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The query in DuckDB: all pairs of one label, and what links reach.
OP11_SQL = """WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.r AS x, b.r AS y FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.93 ELSE false END),
t(r, z) AS (SELECT r, r FROM e UNION SELECT t.r, p.y FROM t JOIN p ON t.z = p.x),
m AS (SELECT t.r, min(e.vec_id) AS c FROM t JOIN e ON t.z = e.r GROUP BY t.r),
n AS (SELECT x AS r, count(*) AS n FROM p GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, coalesce(vec_id = c, false) AS kept FROM e JOIN m USING (r) LEFT JOIN n USING (r)"""
