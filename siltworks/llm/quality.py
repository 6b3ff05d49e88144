"""Quality classifier: ridge scores on random Fourier features of document statistics, then isotonic calibration.

Statistics of the whole text are standardised and mapped to cosines of random projections, whose
inner products approximate a Gaussian kernel. Each partition of the training rows sums its part of
the normal equations; the sums, whose size does not depend on the data, are solved on the driver.
Part of the training rows is kept out of the fit and calibrates the raw scores by a monotone fit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, without

#: Bound on the labelled rows that the model is fitted on; those with the smallest hash of doc_id.
MAX_TRAINING_ROWS = 20_000
FEATURES, RIDGE, SEED = 384, 1e-3, 11
THRESHOLD = 0.7
PARTS = 8
#: Bytes that make up the classes whose shares are statistics.
CLASSES = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\x0b\x0c\r", b"\n", b".", b",", b"!", b"?", b"|",
    b"#$%&*", b"+-/=<>@^_~\\", b"\"'()[]{}:;`", bytes(range(128, 256)),
]
CLASS_OF = np.zeros((256, len(CLASSES)))
for _i, _c in enumerate(CLASSES):
    CLASS_OF[list(_c), _i] = 1


def statistics(text: str) -> np.ndarray:
    """Statistics of one whole text; finite for every text, the empty one included."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    counts = np.bincount(data, minlength=256).astype(float)
    n = max(1, len(data))
    shares = counts @ CLASS_OF / n
    p = counts[counts > 0] / n
    words = text.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=float, count=len(words)) if words else np.zeros(1)
    same = sum(map(str.__eq__, words, words[1:]))
    often = Counter(words)
    top = max(often.values(), default=0)
    lines = text.split("\n")
    rest = [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(often) / k, same / k, top / k,
        np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        np.log1p(len(words)) - np.log1p(len(often)),
    ]
    return np.concatenate([np.sqrt(shares), rest])


N_STATISTICS = len(statistics(""))


def _stats_matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts]).reshape(-1, N_STATISTICS)


@dataclass(frozen=True)
class Model:
    """A fitted classifier; with no labels every score is 0.5."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def map(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.map(stats) @ self.weights

    def probability(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs plus score (0 to 1) and predicted (1 from THRESHOLD on) of each whole text.

        A null text scores as the empty one. Only the text is looked at. Existing columns called
        score or predicted are replaced.
        """
        docs = without(docs, "score", "predicted")
        at = docs.columns.index(text_col)
        inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in inner.schema.fields), T.StructField("score", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = pa.array(self.probability(_stats_matrix(batch.column(at).to_pylist())))
                yield pa.RecordBatch.from_arrays([*batch.columns, values], schema.names)

        scored = mapped(inner, run, schema).toDF(*docs.columns, "score")
        return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def monotone(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: block centres and their means."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum of scores, sum of labels, size
    for s, y in zip(scores[order], labels[order]):
        blocks.append([s, y, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _partition_sums(rows: DataFrame, fold, size: int) -> np.ndarray:
    """The sum over partitions of fold(stats, labels), a vector of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            x = np.stack(b.column(0).to_numpy(zero_copy_only=False)) if b.num_rows else np.empty((0, N_STATISTICS))
            total += fold(x, b.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    # PARTS bounds how many sums reach the driver
    parts = mapped(rows.select("stats", "y").coalesce(PARTS), run, "s array<double>").collect()
    return np.sum([np.array(p.s) for p in parts], axis=0) if parts else np.zeros(size)


def bucket(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Fits on labelled rows outside the held-out quarter (crc32(doc_id) mod 4 = 2).

    Labels with a null doc_id or quality are skipped, and of contradicting labels the 0 counts. At
    most max_rows labelled rows are used. With labels of one kind only, every score is that label.
    """
    known = labels.where("doc_id is not null and quality is not null").where(bucket(F.col("doc_id")) != 2)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    schema = "doc_id long, y double, stats array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = pa.array(list(_stats_matrix(b.column(2).to_pylist())), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), stats], ["doc_id", "y", "stats"])

    # max_rows bounds what is broadcast
    found = docs.select(F.col("doc_id").cast("bigint"), "text").join(F.broadcast(known.select(F.col("doc_id").cast("bigint"), "y")), "doc_id")
    rows = mapped(found.select("doc_id", "y", "text"), run, schema).repartition(PARTS, "doc_id").sortWithinPartitions("doc_id").persist()
    d = N_STATISTICS
    moments = _partition_sums(rows, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * d)
    n, positive = moments[0], moments[1]
    rng = np.random.default_rng(SEED)
    directions = rng.normal(size=(d, FEATURES)) / np.sqrt(d)
    phases = rng.uniform(0, 2 * np.pi, FEATURES)
    if n == 0 or positive in (0, n):
        level = 0.5 if n == 0 else positive / n
        rows.unpersist()
        return Model(np.zeros(d), np.ones(d), directions, phases, np.zeros(FEATURES + 1), np.zeros(1), np.array([level]))
    mean = moments[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(moments[2 + d :] / n - mean**2, 0))
    blank = Model(mean, np.where(scale > 1e-9, scale, 1.0), directions, phases, np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    own = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(4)) != 0
    m = FEATURES + 1

    def equations(x, y):
        z = blank.map(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _partition_sums(rows.where(own), equations, m * m + m)
    ridge = RIDGE * max(1.0, n) / m * np.eye(m)
    weights = np.linalg.solve(sums[: m * m].reshape(m, m) + ridge, sums[m * m :])
    kept = rows.where(~own).select("stats", "y").collect()  # a quarter of max_rows at most
    rows.unpersist()
    model = Model(blank.mean, blank.scale, directions, phases, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    if not kept:
        return model
    knots, levels = monotone(model.raw(np.array([r.stats for r in kept])), np.array([r.y for r in kept]))
    return Model(blank.mean, blank.scale, directions, phases, weights, knots, levels)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out (false for a null doc_id, which no label can have), score and predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs).select("doc_id", F.coalesce(bucket(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
