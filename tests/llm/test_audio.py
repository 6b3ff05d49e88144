"""Fingerprints and alignment of known signals, against brute force over all offsets."""

import io
import wave

import numpy as np
from pyspark.sql import functions as F

from siltworks.llm.audio import BIT_ERRORS, OVERLAP, _classes, add_fingerprints, align, chroma, decode_wav, fingerprint, matches, op3_audio_fingerprints


def wav(samples, rate=4000, width=2, channels=1):
    b = io.BytesIO()
    with wave.open(b, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        x = np.repeat(samples, channels)
        if width == 1:
            raw = np.clip(np.rint(x * 128 + 128), 0, 255).astype(np.uint8).tobytes()
        else:
            full = (x * (2 ** (8 * width - 1) - 1)).astype(np.int64)
            raw = b"".join(int(v).to_bytes(width, "little", signed=True) for v in full)
        w.writeframes(raw)
    return b.getvalue()


def tune(seed, seconds, rate=4000):
    rng = np.random.default_rng(seed)
    t = np.arange(rate // 4) / rate
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 24) / 12) * t) for _ in range(seconds * 4)]) * 0.7


def test_chroma_and_wav_widths():
    x = np.sin(2 * np.pi * 440 * np.arange(8000) / 4000) * 0.8
    assert (chroma(x, 4000).argmax(1) == 0).all()  # 440 Hz is class 0
    for width in (1, 2, 3, 4):
        for channels in (1, 2):
            y, rate = decode_wav(wav(x[:1000], width=width, channels=channels))
            assert rate == 4000 and np.abs(y - x[:1000]).max() < 0.02
    # sample widths that are no usual PCM have no samples, and stop nothing
    head = wav(x[:1000], width=2)
    odd = head[:32] + (5).to_bytes(2, "little") + (40).to_bytes(2, "little") + head[36:]
    assert len(decode_wav(odd)[0]) == 0
    assert len(decode_wav(b"junk")[0]) == len(decode_wav(None)[0]) == len(fingerprint(x[:10], 4000)) == 0


def brute(a, b):
    best = None
    for shift in range(-len(a) + 1, len(b)):
        x, y = a[max(0, -shift) :], b[max(0, shift) :]
        n = min(len(x), len(y))
        if n >= OVERLAP * min(len(a), len(b)):
            e = sum(((int(p) ^ int(q)) & 0xFFFFFFFF).bit_count() for p, q in zip(x[:n], y[:n])) / (32 * n)
            if e <= BIT_ERRORS and (best is None or e < best[1]):
                best = shift, e
    return best


def test_alignment(spark):
    a, b = tune(1, 20), tune(2, 20)
    noisy = np.clip(a + np.random.default_rng(0).normal(0, 0.02, len(a)), -1, 1)
    rows = [(100, wav(a), 1), (7, wav(a), 1), (7, wav(a), 1), (1, wav(noisy), 1), (2, wav(a[4000 * 5 :]), 1), (3, wav(b), 1), (200, wav(b[4000 * 2 :]), 1),
            (4, wav(tune(3, 20)), 1), (5, None, 1), (6, b"", 1), (None, wav(tune(4, 9)), 1), (8, wav(a[:1500]), 1)]
    df = spark.createDataFrame(rows, "id long, media binary, Fingerprint int")
    made = add_fingerprints(df)
    assert made.columns == ["id", "media", "fingerprint"]
    got = {r.id: (r.class_id, r.query_id, r["shift"]) for r in align(made, F.col("id") % 100 == 0).collect()}
    assert got[100] == got[7] == (7, 7, 0)
    assert got[1] == (1, 7, 0) and got[2][1:] == (7, 40) and got[3][1:] == (200, -16) and got[200] == (200, 200, 0)
    assert got[4] == (4, None, None) and got[5] == (5, None, None) and got[6] == (6, None, None) and got[8] == (8, None, None)
    prints = {r.id: r.fingerprint for r in made.collect()}
    for i in (1, 2, 4):
        best = brute(prints[i], prints[100])
        assert (best and best[0]) == got[i][2]
    assert align(made.limit(0), F.col("id") % 100 == 0).collect() == [] and add_fingerprints(df.limit(0)).collect() == []


def test_recall_of_noisy_and_cropped_recordings(spark):
    """Against all offsets: of the pairs that brute force aligns, nearly all are found, and no others."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(8):
        x = tune(10 + k, 12)
        rows.append((100 * k, wav(x)))
        for m, noise in enumerate((0.02, 0.1, 0.2, 0.3)):
            y = x[rng.integers(0, 4000 * 3) :]
            rows.append((100 * k + m + 1, wav(np.clip(y + rng.normal(0, noise, len(y)), -1, 1))))
    made = add_fingerprints(spark.createDataFrame(rows, "id long, media binary")).cache()
    prints = {r.id: r.fingerprint for r in made.collect()}
    asked = F.col("id") % 100 == 0
    want = {(a, q): brute(prints[a], prints[q]) for a in prints for q in range(0, 800, 100) if a != q}
    want = {k: v for k, v in want.items() if v}
    assert len(want) >= 20
    frame = made.select("id", F.col("fingerprint").alias("fp"), asked.alias("asked"), F.col("id").cast("string").alias("mark"))
    got = {(int(r.mark), r.query_id): r.bit_errors for r in matches(_classes(frame)).collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)


def test_every_row_gives_one(spark):
    a = tune(1, 6)
    df = spark.createDataFrame([(7, wav(a)), (7, wav(a)), (None, wav(a)), (None, None), (100, wav(a[2000:]))], "id long, media binary")
    got = align(add_fingerprints(df), F.col("id") % 100 == 0).collect()
    assert sorted(str((r.id, r.class_id)) for r in got) == ["(100, 100)", "(7, 7)", "(7, 7)", "(None, 7)", "(None, None)"]


def test_query(spark):
    out = op3_audio_fingerprints(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert all(r.query_id is not None for r in rows if r.vec_id % 100 == 0) and all(r.n_ints > 40 for r in rows)
