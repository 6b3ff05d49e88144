"""Sending minimiser runs to shards, and putting removed spans back on their documents.

A run is a stretch of consecutive windows with one minimiser; it travels as the one string that
covers its windows. Equal windows have equal minimisers, so they meet in the same shard whatever
document they are in. Runs of one task that go to one shard share a compressed row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, without

#: Bytes of text or runs that are worked on at once; bounds memory, not results.
CHUNK = 1 << 20
PIECE = 1 << 21
#: Text for one shard. A task holds the runs of one shard at a time, and of up to SHARDS_A_TASK one after the other.
SHARD_BYTES, SHARDS_A_TASK = 16 << 20, 64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def need(cls, n: int) -> None:
        if len(cls.up) < n:
            for name, base in (("up", BASE), ("down", INVERSE)):
                factors = np.full(n + 1, base, np.uint64)
                factors[0] = 1
                setattr(cls, name, np.cumprod(factors, dtype=np.uint64))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of bytes, from which slice_hash takes any slice's hash."""
    Powers.need(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Powers.up[: len(data)], out=out[1:])
    return out


def slice_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (sums[ends] - sums[starts]) * Powers.down[starts]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads hashes over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values."""
    reach, out = 1, values
    while reach < width:
        step = min(reach, width - reach)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        reach += step
    return out


COLUMNS = ("minimiser", "doc", "row", "start", "again")


@dataclass
class Runs:
    """Runs of windows: minimiser, document, row, first window, whether the run may repeat within itself, and its string."""

    minimiser: np.ndarray
    doc: np.ndarray
    row: np.ndarray
    start: np.ndarray
    again: np.ndarray
    strings: list[bytes]

    def packed(self, chosen: np.ndarray) -> bytes:
        lengths = np.fromiter((len(self.strings[i]) for i in chosen), np.int64, len(chosen))
        columns = [np.int64(len(chosen)), self.minimiser[chosen], self.doc[chosen], self.row[chosen], self.start[chosen], self.again[chosen].astype(np.int64), lengths]
        return b"".join([c.tobytes() for c in columns] + [self.strings[i] for i in chosen])


def unpacked(blobs: list[bytes]) -> Runs:
    reader = zstandard.ZstdDecompressor()
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    strings: list[bytes] = []
    for blob in blobs:
        data = reader.decompress(blob)
        n = int(np.frombuffer(data, np.int64, 1)[0])
        heads = np.frombuffer(data, np.int64, 6 * n, 8).reshape(6, n)
        for c, h in zip(columns, heads):
            c.append(h)
        ends = np.cumsum(heads[5]) + 8 * (6 * n + 1)
        strings += [data[e - k : e] for e, k in zip(ends.tolist(), heads[5].tolist())]
    minimiser, doc, row, start, again = (np.concatenate(c) if c else np.empty(0, np.int64) for c in columns)
    return Runs(minimiser, doc, row, start, again, strings)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs plus __doc and __row, which name a row by its id (null: the smallest long) and its text."""
    txt = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.withColumn("__doc", F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(-(1 << 63)))).withColumn("__row", F.xxhash64(txt))


def shards_for(texts: DataFrame) -> int:
    """The number of shards for texts (__text): the session's partitions, or more where a shard would grow beyond SHARD_BYTES."""
    total = texts.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(tasks, min(total // SHARD_BYTES + 1, SHARDS_A_TASK * tasks))


def to_shards(texts: DataFrame, cut_runs: Callable[[list[bytes], np.ndarray, np.ndarray], Runs], shards: int) -> DataFrame:
    """(shard, blob) of texts (__doc, __row, __text), each text cut into runs by cut_runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        held: list[Runs] = []
        size = 0

        def emit():
            nonlocal size
            if held:
                all_runs = Runs(*(np.concatenate([getattr(r, k) for r in held]) for k in COLUMNS), [s for r in held for s in r.strings])
                held.clear()
                size = 0
                # the low bits order pieces within a shard, so shards take the high ones
                shard = ((all_runs.minimiser.view(np.uint64) >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                bounds = np.flatnonzero(np.diff(shard[order])) + 1
                for part in np.split(order, bounds):
                    if len(part):
                        yield pa.RecordBatch.from_arrays([pa.array([shard[part[0]]], pa.int32()), pa.array([packer.compress(all_runs.packed(part))], pa.binary())], ["shard", "blob"])

        for batch in batches:
            docs, rows = (batch.column(i).to_numpy() for i in (0, 1))
            at = 0
            while at < batch.num_rows:
                group, first, total = [], at, 0
                while at < batch.num_rows and total < CHUNK:
                    group.append(batch.column(2)[at].as_py().encode())
                    total += len(group[-1])
                    at += 1
                held.append(cut_runs(group, docs[first:at], rows[first:at]))
                size += sum(map(len, held[-1].strings))
                if size >= 24 * CHUNK:
                    yield from emit()
        yield from emit()

    return mapped(texts.select("__doc", "__row", "__text"), run, "shard int, blob binary")


def spans_of_shards(blobs: DataFrame, removed: Callable[[Runs], Iterator[tuple[int, int, int]]]) -> DataFrame:
    """(__doc, __row, __from, __to) that removed() finds in pieces of each shard.

    A piece holds whole minimisers. Runs alone with their minimiser are left out, unless they may
    repeat within themselves.
    """

    def pieces(blobs: list[bytes]) -> Iterator[Runs]:
        runs = unpacked(blobs)
        order = np.argsort(runs.minimiser, kind="stable")
        m = runs.minimiser[order]
        first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1]))) if len(m) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(m)))
        single = np.repeat(size == 1, size)
        order = order[~single | (runs.again[order] != 0)]
        m = runs.minimiser[order]
        held, total = [], 0
        for n, i in enumerate(order.tolist()):
            if held and total >= PIECE and m[n] != m[n - 1]:
                yield _taken(runs, held)
                held, total = [], 0
            held.append(i)
            total += len(runs.strings[i])
        if held:
            yield _taken(runs, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(blobs):
                got = [(int(piece.doc[i]), int(piece.row[i]), a, b) for i, a, b in removed(piece)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], ["__doc", "__row", "__from", "__to"])

        now, held = None, []
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != now:
                    yield from found(held)
                    now, held = shard, []
                held.append(blob)
        yield from found(held)

    tasks = int(blobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blobs.repartition(tasks, "shard").sortWithinPartitions("shard")
    return mapped(dealt, run, "__doc long, __row long, __from long, __to long")


def _taken(runs: Runs, chosen: list[int]) -> Runs:
    at = np.array(chosen)
    return Runs(*(getattr(runs, k)[at] for k in COLUMNS), [runs.strings[i] for i in chosen])


def intervals(flags: np.ndarray, width: int) -> list[tuple[int, int]]:
    """The stretches covered by flagged windows of this width."""
    edges = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) + width - 1).tolist()))


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as maximal disjoint ones, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame, spans: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """docs (with __doc and __row) plus __spans, the removed spans of each row; names are left free."""
    of_doc = spans.groupBy("__doc", "__row").agg(F.collect_list(F.struct("__from", "__to")).alias("__spans"))
    return without(docs, *names).join(of_doc, ["__doc", "__row"], "left")
