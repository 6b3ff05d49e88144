"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from siltworks.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, key string, component_id int"


def brute(rows):
    """{position: (n_links, component_id, kept)} by all pairs."""
    n = len(rows)
    vecs = [None if r[1] is None or r[2] is None or not r[1] or any(x is None or not np.isfinite(x) for x in r[1]) or not any(r[1]) else np.array(r[1], np.float32).astype(float) for r in rows]
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            a, b = vecs[i], vecs[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        first = min(ids, default=None)
        out.append((rows[i][0], len(links[i]), first, rows[i][0] is not None and rows[i][0] == first))
    return out


def cloud(rng, dims, centres, each, noise):
    c = rng.standard_normal((centres, dims))
    return np.concatenate([c[i] / np.linalg.norm(c[i]) + rng.standard_normal((each, dims)) * noise for i in range(centres)])


@pytest.mark.parametrize("rows_a_cell", [4096, 40])
def test_equals_all_pairs(spark, rows_a_cell):
    rng = np.random.default_rng(3)
    dense = cloud(rng, 64, 1, 220, 0.012)  # a third of all rows, in one ball
    spread = cloud(rng, 64, 30, 8, 0.03)  # cosines around the threshold
    other = cloud(rng, 48, 20, 6, 0.03)
    vecs = [(v, 1) for v in dense] + [(v, 1) for v in spread] + [(v, 2) for v in other] + [(spread[0], 1)] * 30 + [(spread[0] * 2, 1), (spread[0], 2)]
    rows = [(i, [float(np.float32(x)) for x in v], label, "k", 0) for i, (v, label) in enumerate(vecs)]
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA), rows=rows_a_cell)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_dense_groups_fold_into_balls():
    rng = np.random.default_rng(4)
    x = np.concatenate([cloud(rng, 64, 1, 200, 0.012), rng.standard_normal((400, 64))]).astype(np.float32)
    plan = E.Plan(64, [v.tobytes() for v in x], "f4", 0.93)
    unit = x / np.linalg.norm(x.astype(float), axis=1)[:, None]
    ball = E._ball(plan, unit, 0.93)
    assert (ball[:200] >= 0).mean() > 0.9 and (ball[200:] < 0).all()


def test_rotation_is_exact_in_any_batch():
    rng = np.random.default_rng(5)
    for dims in (1, 3, 64, 700):
        space = E.Space.of(dims, 0.93)
        unit = rng.standard_normal((50, dims))
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        whole = space.rotated(unit)
        assert all((space.rotated(unit[i : i + 1])[0] == whole[i]).all() for i in range(50))
        assert np.allclose((whole**2).sum(1) / space.scale**2, 1, atol=1e-3)


def test_threshold_itself_links(spark):
    # 93 of 100: the cosine is 0.93 exactly
    rows = [(1, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 0, "", 0), (2, [93.0, 36.0, 7.0, 2.0, 1.0, 1.0], 0, "", 0), (3, [93.0, -36.0, 7.0, 2.0, 2.0, 1.0], 0, "", 0)]
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    # the third vector is just short of the threshold to the first
    assert 93**2 + 36**2 + 7**2 + 2**2 + 1 + 1 == 100**2
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_nulls_repeats_and_empty_tables(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (5, [1.0, 0.0], 1, "", 0), (5, [1.0, 0.0], 1, "", 0), (None, [2.0, 0.0], 1, "", 0), (None, [0.0, 1.0], 1, "", 0), (4, [0.0, 3.0], None, "", 0),
        (7, None, 1, "", 0), (8, [], 1, "", 0), (9, [0.0, 0.0], 1, "", 0), (10, [1.0, None], 1, "", 0), (11, [1.0, nan], 1, "", 0), (12, [inf, 1.0], 1, "", 0), (13, [1.0, 0.0, 0.0], 1, "", 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, E.near_duplicates(df).collect()), key=key) == sorted(brute(rows), key=key)
    assert E.near_duplicates(df.limit(0)).collect() == []
    doubles = df.selectExpr("vec_id", "cast(embedding as array<double>) as embedding", "label")
    assert sorted(map(tuple, E.near_duplicates(doubles).collect()), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("stripes", [4, 5])
def test_vectors_travel_twice_in_a_round_at_most(spark, monkeypatch, stripes):
    """However many stripes a label has, no step deals out more than two rows for each vector."""
    rng = np.random.default_rng(6)
    vecs = cloud(rng, 32, 50, 10, 0.05)
    rows = [(i, [float(np.float32(x)) for x in v], 1, "k", 0) for i, v in enumerate(vecs)]
    dealt, keep = [], E.mapped
    monkeypatch.setattr(E, "mapped", lambda df, *a: dealt.append(df.count()) or keep(df, *a))
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA), rows=len(rows) // stripes)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))
    assert len(dealt) > 3 and max(dealt) <= 2 * len(rows)


def test_leaves_hold_all_pairs_within_the_budget():
    rng = np.random.default_rng(8)
    own = np.rint(cloud(rng, 16, 40, 60, 0.02) * 1000)
    ball, tile = rng.integers(-1, 2, len(own)), rng.integers(0, 2, len(own))
    square = ((own[:, None] - own[None]) ** 2).sum(2) <= 150**2
    square &= (ball[:, None] < 0) | (ball[:, None] != ball[None])
    for t in (tile, 0 * tile):
        got = [(min(a, b), max(a, b)) for i, j in E.near(own, 150**2, 1000.0, ball, t) for a, b in zip(i.tolist(), j.tolist())]
        want = {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(np.triu(square, 1)))) if not t.any() or t[a] != t[b]}
        assert len(got) == len(set(got)) and want and want <= set(got) and len(got) < 1.01 * len(want) + 9
