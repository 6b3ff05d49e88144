"""Media columns: chroma fingerprints of audio, and their alignment.

A recording (a binary column with PCM WAV data) becomes frames of twelve pitch-class energies. Filters
that compare rectangles of that image, read off an integral image, are quantised to two bits each and
packed into one integer per position. Parts of the bits of a few integers are looked up in other
recordings: a histogram of the offsets at which they agree gives the offsets to try, and the share of
differing bits over the whole overlap confirms one.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, mapped, sha256_hex, without

FRAME_SECONDS, FRAMES_PER_SECOND = 0.5, 8
LOWEST, HIGHEST = 55.0, 3520.0
#: Frames that one integer looks at.
WIDTH = 8
THRESHOLDS = (-0.25, 0.0, 0.25)
#: A vote rests on three integers STEP places apart, of each of which it takes PART_BITS bits; wrong bits leave the other
#: votes of a place as they are. NEAR_TOP offsets of each histogram are checked.
STEP, SPAN, PART_BITS, NEAR_TOP = 4, 9, 11, 3
#: Largest share of differing bits of aligned recordings, and least share of the shorter one that overlaps.
BIT_ERRORS, OVERLAP = 0.15, 0.5
BROADCAST_KEYS = 1_000_000


def decode_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Samples of a PCM WAV file of 8 to 32 bits as one channel from -1 to 1, and their rate; nothing for other data."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
            raw = w.readframes(w.getnframes())
    except (wave.Error, EOFError, RuntimeError):
        return np.empty(0), 0
    if width not in (1, 2, 3, 4):
        return np.empty(0), 0
    raw = raw[: len(raw) // (width * channels) * (width * channels)]
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float64) / 128 - 1
    elif width == 2:
        x = np.frombuffer(raw, "<i2") / 32768
    elif width == 4:
        x = np.frombuffer(raw, "<i4") / 2147483648
    else:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 8388608
    return x.reshape(-1, channels).mean(1), rate


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Energies of the twelve pitch classes in each frame, scaled to sum 1 where there is sound."""
    size, hop = int(rate * FRAME_SECONDS), max(1, rate // FRAMES_PER_SECOND)
    if rate <= 0 or size < 2 or len(samples) < size:
        return np.zeros((0, 12))
    bins = np.fft.rfftfreq(size, 1 / rate)
    use = np.flatnonzero((bins >= LOWEST) & (bins <= HIGHEST))
    pitch = np.rint(12 * np.log2(bins[use] / 440)).astype(int) % 12
    to_class = np.zeros((len(use), 12))
    to_class[np.arange(len(use)), pitch] = 1
    window = np.hanning(size)
    views = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop]
    out = []
    for at in range(0, len(views), 512):  # long recordings go through in parts
        power = np.abs(np.fft.rfft(views[at : at + 512] * window, axis=1)[:, use]) ** 2
        out.append(power @ to_class)
    energy = np.concatenate(out)
    total = energy.sum(1, keepdims=True)
    return np.divide(energy, total, out=np.zeros_like(energy), where=total > 1e-9)


def filters() -> list[tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]]:
    """Sixteen filters: rectangles (frame from, to, class from, to) that add, and those that subtract.

    By turns they compare early with late frames, low with high classes, the corners of a square with
    its other corners, and a middle band of classes with its neighbours; places and sizes step through
    the image.
    """
    out = []
    for k in range(16):
        high = 2 + 2 * (k // 4 % 2)
        low = (5 * k) % (12 - 2 * high + 1)
        wide = (4, 8, 6, 8)[k // 4]
        half, mid, top = wide // 2, low + high, low + 2 * high
        if k % 4 == 0:
            out.append(([(0, half, low, top)], [(half, wide, low, top)]))
        elif k % 4 == 1:
            out.append(([(0, wide, low, mid)], [(0, wide, mid, top)]))
        elif k % 4 == 2:
            out.append(([(0, half, low, mid), (half, wide, mid, top)], [(half, wide, low, mid), (0, half, mid, top)]))
        else:
            q = high // 2
            out.append(([(0, wide, low + q, top - q)], [(0, wide, low, low + q), (0, wide, top - q, top)]))
    return out


FILTERS = filters()


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """Packed 32-bit integers, one for each position of the filters; none for recordings that are too short."""
    image = chroma(samples, rate)
    n = len(image) - WIDTH + 1
    if n < 1:
        return np.empty(0, np.int32)
    integral = np.zeros((len(image) + 1, 13))
    integral[1:, 1:] = image.cumsum(0).cumsum(1)

    def area(a: int, b: int, c: int, d: int) -> np.ndarray:
        at = np.arange(n)
        return integral[at + b, d] - integral[at + a, d] - integral[at + b, c] + integral[at + a, c]

    packed = np.zeros(n, np.uint32)
    for plus, minus in FILTERS:
        value = np.log((0.1 + sum(area(*r) for r in plus)) / (0.1 + sum(area(*r) for r in minus)))
        level = np.searchsorted(THRESHOLDS, value)
        packed = packed << np.uint32(2) | (level ^ level >> 1).astype(np.uint32)  # neighbours differ in one bit
    return packed.view(np.int32)


def add_fingerprints(df: DataFrame, media_col: str = "media", out: str = "fingerprint") -> DataFrame:
    """df plus the fingerprint (array of int) of the recordings in media_col.

    Null, empty and undecodable media have no integers. Rows are independent; an existing column
    called out is replaced.
    """
    df = without(df, out)
    at = df.columns.index(media_col)
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = T.StructType([*inner.schema.fields, T.StructField("fp", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                made = [fingerprint(*decode_wav(m)) for m in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.list_(pa.int32()))], schema.names)

    return mapped(inner, run, schema).toDF(*df.columns, out)


def _runs(classes: DataFrame) -> DataFrame:
    """(mark, place, run): what a recording votes with; places whose run goes on from the one before have no vote.

    So steady notes and silence, which many recordings share, vote once where they begin. Recordings
    of fewer than SPAN integers vote with single integers, and only among each other.
    """
    def key(i: str) -> str:
        size = 1 << PART_BITS
        part = f"(shiftrightunsigned(fp[{{}}], {PART_BITS} * k) & {size - 1})"
        return f"(((k * {size}L + {part.format(f'{i} - 1')}) * {size}L + {part.format(f'{i} - 1 + {STEP}')}) * {size}L + {part.format(f'{i} - 1 + {2 * STEP}')})"

    places = f"transform(sequence(1, greatest(1, size(fp) - {SPAN - 1})), i -> transform(sequence(0, {32 // PART_BITS - 1}), k -> named_struct('place', i, 'run', {key('i')}, 'old', if(i > 1, {key('(i - 1)')}, -1L))))"
    long = classes.where(F.size("fp") >= SPAN).select("mark", F.expr(f"inline(flatten({places}))")).where("run <> old").select("mark", "place", "run")
    short = classes.where(F.size("fp") < SPAN).select("mark", F.posexplode("fp").alias("place", "x"))
    return long.unionByName(short.select("mark", (F.col("place") + 1).alias("place"), (F.col("x").cast("bigint") - (1 << 40)).alias("run")))


def _classes(rows: DataFrame) -> DataFrame:
    """One row (mark, class_id, asked, fp) for the recordings with one fingerprint."""
    return rows.where("size(fp) > 0").groupBy("mark").agg(
        F.min("id").alias("class_id"), F.max(F.coalesce("asked", F.lit(False))).alias("asked"), F.min("fp").alias("fp"))


def matches(classes: DataFrame) -> DataFrame:
    """(mark, query, query_id, shift, bit_errors): every class with every other class that holds a query and aligns with it.

    Of the NEAR_TOP offsets with most votes the one with the fewest differing bits counts; shift is the
    place in the query where the recording starts.
    """
    runs = _runs(classes)
    asked = runs.join(classes.where("asked").select("mark"), "mark").toDF("query", "at", "run")
    small = asked.count() <= BROADCAST_KEYS
    votes = runs.join(F.broadcast(asked) if small else asked, "run").where("mark <> query")
    votes = votes.groupBy("mark", "query", (F.col("at") - F.col("place")).alias("shift")).agg(F.count("*").alias("votes"))
    first = Window.partitionBy("mark", "query").orderBy(F.desc("votes"), F.abs("shift"), "shift")
    top = votes.withColumn("n", F.row_number().over(first)).where(f"n <= {NEAR_TOP}").select("mark", "query", "shift")
    fps = classes.select("mark", "class_id", "fp")
    both = top.join(fps.select("mark", "fp"), "mark").join(fps.toDF("query", "query_id", "qfp"), "query")
    start, qstart = F.greatest(F.lit(0), -F.col("shift")), F.greatest(F.lit(0), F.col("shift"))
    n = F.least(F.size("fp") - start, F.size("qfp") - qstart)
    both = both.withColumn("n", n).where(f"n > 0 and n >= {OVERLAP} * least(size(fp), size(qfp))")
    # a difference in the top bit makes a negative integer, whose count of bits would be that of a long
    differ = F.aggregate(
        F.zip_with(F.slice("fp", start + 1, F.col("n")), F.slice("qfp", qstart + 1, F.col("n")), lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("bigint").bitwiseAND(F.lit((1 << 32) - 1)))),
        F.lit(0), lambda a, b: a + b)
    both = both.withColumn("bit_errors", F.round(differ / (32 * F.col("n")), 6)).where(F.col("bit_errors") <= BIT_ERRORS)
    best = both.groupBy("mark", "query").agg(F.min(F.struct("bit_errors", F.abs("shift").alias("far"), "shift", "query_id")).alias("b"))
    return best.select("mark", "query", "b.query_id", "b.shift", "b.bit_errors")


def align(recordings: DataFrame, is_query, id_col: str = "id", fp_col: str = "fingerprint") -> DataFrame:
    """For each recording: id_col, n_ints, fingerprint_sha256, class_id, n_queries, query_id, shift, bit_errors.

    Recordings with equal fingerprints form a class, named by its smallest id; those without integers
    are classes of their own. n_queries is the number of other classes with a query (a row where
    is_query holds) that the class aligns with. A class with a query has itself as best query; others
    have the class with the fewest differing bits, then the smallest one, or null. Every row of
    recordings gives one row, repeated and null ids included.
    """
    rows = cut(recordings.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{fp_col}`").alias("fp"), is_query.alias("asked"),
        sha256_hex(F.array_join(F.col(f"`{fp_col}`").cast("array<string>"), " ")).alias("mark")))
    # one fingerprint of a class stands for all
    classes = cut(_classes(rows))
    found = matches(classes).groupBy("mark").agg(F.count("*").alias("n_queries"), F.min(F.struct("bit_errors", "query_id", "shift")).alias("b"))
    own = F.struct(F.lit(0.0).alias("bit_errors"), F.col("class_id").alias("query_id"), F.lit(0).alias("shift"))
    named = classes.select("mark", "class_id", "asked").join(found, "mark", "left").withColumn("b", F.when(F.col("asked"), own).otherwise(F.col("b")))
    out = rows.join(named.drop("asked"), "mark", "left")
    whole = F.when(F.size("fp") > 0, F.col("class_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce(F.size("fp"), F.lit(0)).cast("bigint").alias("n_ints"), F.col("mark").alias("fingerprint_sha256"), whole.alias("class_id"),
        F.coalesce("n_queries", F.lit(0)).cast("bigint").alias("n_queries"), "b.query_id", F.col("b.shift").cast("int").alias("shift"), "b.bit_errors")


RATE, NOTE_SECONDS = 2000, 0.125


def render(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, media): each vector played as a WAV recording, a note for each component. Null vectors are silent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(int(RATE * NOTE_SECONDS)) / RATE
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                media = []
                for v in part.column(1).to_pylist():
                    notes = np.clip(np.rint(np.nan_to_num(np.array([x or 0.0 for x in v or []])) * 40) + 12, 0, 23)
                    pitch = 220 * 2 ** (notes / 12)
                    wave_ = np.sin(2 * np.pi * pitch[:, None] * t).ravel()
                    buffer = io.BytesIO()
                    with wave.open(buffer, "wb") as w:
                        w.setnchannels(1)
                        w.setsampwidth(2)
                        w.setframerate(RATE)
                        w.writeframes((wave_ * 20000).astype("<i2").tobytes())
                    media.append(buffer.getvalue())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["id", "media"])

    chosen = vectors.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{vector_col}`").cast("array<double>"))
    return mapped(chosen, run, "id long, media binary")


def op3_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of embeddings played as a recording, fingerprinted, and aligned with those whose id is divisible by 100."""
    made = add_fingerprints(render(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))).drop("media")
    return align(made, F.col("id") % 100 == 0).withColumnRenamed("id", "vec_id")
