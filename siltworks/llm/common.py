"""Helpers that several operators share: checkpoints, private column names, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are runs of anything else.
SPACES = " \t\n\x0b\x0c\r"
#: Up to this many edges (twice 16 MB of minima) components are computed with broadcast joins.
FEW_EDGES = 1_000_000


#: Bytes of a batch of rows that goes to Python, so that long texts don't pile up on either side.
BATCH_BYTES = 4 << 20


def ready(spark: SparkSession) -> None:
    """Make sure checkpoint() has a folder: the cluster's own, or a temporary one where a local session has none."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="siltworks-checkpoint-"))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of bounded bytes; workers give back what they don't use after a task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Return freed memory of this process to the system; a worker stays idle beside JVM work for a while."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of an action go when the action ends, not when the driver collects garbage.

    For frames that run once, such as those that cut() writes.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sha256_hex(column: Column | str) -> Column:
    return F.sha2(F.col(column) if isinstance(column, str) else column, 256)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that a result adds itself, whatever their case."""
    lowered = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in lowered])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph as (node, component), component being the smallest node.

    Alternates the large-star and small-star steps until the edges stop changing. Each step is a
    partially aggregated minimum joined back to the edges, so that no node's neighbours are ever
    gathered in one task. Nodes must be integers; self loops and repeated edges are ignored, and
    nodes without an edge to another node do not appear.
    """
    now = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            break
        mark = tuple(seen)
        # a node has an edge, so the minima are at most twice as many as the edges
        few = seen[0] <= FEW_EDGES
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(F.broadcast(low) if few else low, "u").where("v > u and v <> m")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(F.broadcast(low) if few else low, "u").where("v <> m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    nodes = now.groupBy("u").agg(F.min("v").alias("v"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return nodes.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.join(nodes.select(F.col("u").alias("node")), "node", "left_anti")
    )
