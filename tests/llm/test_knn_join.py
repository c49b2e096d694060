import random

import numpy as np
import pytest

from tallyloom.llm import knn_join as K


def brute(queries, data, k):
    out = []
    for q, v in sorted(set(queries)):
        scored = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in data if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("big", [False, True])
def test_against_brute_force(spark, big):
    rnd = random.Random(8)
    centre = [[rnd.randint(-40, 40) for _ in range(6)] for _ in range(5)]
    data = [(i, tuple(c + rnd.randint(-6, 6) for c in rnd.choice(centre))) for i in range(400)]
    data += [(400 + i, (1, 1, 1, 1, 1, 1)) for i in range(60)] + [(7, data[7][1]), (500, (3, 4)), (501, (0,) * 6)]
    if big:
        data = [(i, tuple(c << 24 for c in v)) for i, v in data]
    queries = [r for r in data if r[0] % 20 == 0]
    d = spark.createDataFrame(data, "vec_id long, v array<long>")
    q = spark.createDataFrame(queries, "vec_id long, v array<long>")
    got = K.knn_join(q, d, k=7, pivots=4, block=8, slice_rows=90)
    assert sorted(tuple(r) for r in got.collect()) == brute(queries, data, 7)


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(3)
    centres = rng.integers(-300, 300, (12, 5)).astype(float)
    x = np.concatenate([c + rng.integers(-9, 10, (50, 5)) for c in centres])
    q = x[::7]
    cell, far = K._nearest(x, centres)
    count = np.bincount(cell, minlength=12)
    radius, norm = np.zeros(12), np.zeros(12)
    np.maximum.at(radius, cell, far), np.maximum.at(norm, cell, np.linalg.norm(x, axis=1))
    needed = K.reach(q, centres, count, radius, norm, 5)
    top = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :6]
    assert all(needed[i, cell[t]].all() for i, t in enumerate(top)) and needed.mean() < 0.4


def test_blocks():
    pivots = np.arange(6.0)[:, None]
    blocks = K.deal_blocks(pivots, {0: 3, 1: 4, 2: 25, 4: 6, 5: 4}, 10)
    load, spans = {}, []
    for c, (first, n) in blocks.items():
        spans += [range(first, first + n)]
        load[first] = load.get(first, 0) + ({0: 3, 1: 4, 2: 25, 4: 6, 5: 4}[c] + n - 1) // n
    assert blocks[2][1] == 3 and max(load.values()) <= 10
    assert set().union(*spans) == set(range(max(max(r) for r in spans) + 1))
    assert K.deal_blocks(pivots, {}, 10) == {}


def test_many_equal_rows(spark):
    data = [(3, (1, 2))] * 50 + [(20, (1, 1))] * 3 + [(20, (2, 1)), (4, (1, 2))]
    d = spark.createDataFrame(data, "vec_id long, v array<long>").coalesce(1)
    got = K.knn_join(d.where("vec_id = 20"), d, k=7, pivots=2)
    assert sorted(tuple(r) for r in got.collect()) == brute([r for r in data if r[0] == 20], data, 7)


def test_few_rows_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.01]), (1, [1.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []), (20, [-inf, 0.0])]
    v = K.quantized(spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<float>, v string"))
    got = K.knn_join(v.where("vec_id % 20 = 0"), v).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 32 * 64 - 64)]


def test_empty(spark):
    v = spark.createDataFrame([], "vec_id long, v array<long>")
    assert K.knn_join(v, v).count() == 0
