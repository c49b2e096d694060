import hashlib
import random
from collections import Counter

import numpy as np

from tallyloom.llm import centroid_clustering as C
from tallyloom.llm.knn_join import quantized

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string"


def slow(rows, k=8, rounds=10, seed=3):
    """Lloyd's rule on Python integers: [(vec_id, cluster, distance)], centroids."""
    rank = lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [list(v) for _, v in sorted(rows, key=rank)[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [nearest(v)[0] for _, v in rows]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(rows, own) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return [(i, *nearest(v)) for i, v in rows], centroids


def vectors(n, seed, spread=0.02):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(8, 64))
    return [(int(k), [float(x) for x in np.float32(centres[k % 8] + spread * rnd.normal(size=64))]) for k in range(n)]


def check(spark, rows, monkeypatch=None, **options):
    data = quantized(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5), scale=1024)
    found = C.cluster_vectors(data, **options)
    whole = [(r["vec_id"], r["v"]) for r in data.collect()]
    want, centroids = slow(whole, **options)
    assert Counter(tuple(r) for r in found.rows.collect()) == Counter(want)
    assert found.centroids == centroids
    return found


def test_clustered_vectors_are_mostly_left_alone(spark, monkeypatch):
    monkeypatch.setattr(C, "_BLOCK", 64)  # several blocks to a task
    found = check(spark, vectors(900, 1))
    assert found.scanned[0] == 900 and found.scanned[-1] < 90


def test_vectors_without_clusters_ties_and_repeated_rows(spark):
    rnd = random.Random(4)
    rows = [(k, [float(rnd.randint(-2, 2)) for _ in range(64)]) for k in range(150)] + [(7, [1.0] * 64)] * 40 + [(k, [0.5] * 64) for k in range(200, 260)]
    check(spark, rows)


def test_few_and_no_vectors(spark):
    check(spark, vectors(3, 2))
    none = C.with_inertia(C.cluster_vectors(quantized(spark.createDataFrame([], SCHEMA), scale=1024)))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_query_passes_over_unfit_rows(spark, tmp_path):
    good = vectors(40, 3)
    odd = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [float("nan")] * 64), (105, [float("inf")] + [0.0] * 63), (106, [None] + [0.0] * 63), (None, [1.0] * 64)]
    spark.createDataFrame([(*r, 1, "x", "y") for r in good + odd], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = C.op11_centroid_clustering(spark, str(tmp_path)).collect()
    assert sorted(r["vec_id"] for r in got) == list(range(40))
    total = Counter()
    for r in got:
        total[r["cluster"]] += r["distance"]
    assert {(r["cluster"], r["cluster_inertia"], r["inertia"]) for r in got} == {(k, n, sum(total.values())) for k, n in total.items()}


def test_a_round_touches_expired_vectors_only():
    """Heaps stay ascending, and a vector left alone is nearest to its centroid still."""
    rnd = np.random.default_rng(5)
    x = rnd.integers(-500, 500, (300, 8)).astype(np.int32)
    c = rnd.integers(-500, 500, (5, 8))
    drift = np.zeros(5)
    heaps, _, n = C.turn(x, None, c, drift)
    assert n == 300
    for _ in range(6):
        after = c + rnd.integers(-6, 7, c.shape)
        p = np.sqrt(((after - c) ** 2).sum(axis=1))
        drift, c = drift + p + [np.delete(p, j).max() for j in range(5)], after
        heaps, _, n = C.turn(x, heaps, c, drift)
        assert n < 300
        own = np.zeros(300, int)
        for j, (gaps, at) in enumerate(heaps):
            assert (np.diff(gaps) >= 0).all()
            own[at] = j
        assert (own == C.distances(x, c).argmin(axis=1)).all()
