import random
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score string, anchor string, rank string"


def slow(rows, wanted):
    """rows: (vec_id, label, v); the contract, anchor by anchor."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, la, va in {(i, la, tuple(v)) for i, la, v in rows if wanted(i)}:
        ranked = sorted((-dot(va, v), i, lb) for i, lb, v in rows if i != a)
        for s, p, _ in [x for x in ranked if x[2] == la][:5]:
            fine = [(-t, n) for t, n, lb in ranked if lb != la and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, k + 1, n, -s, t) for k, (t, n) in enumerate(fine)]
    return Counter(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, lb, "x", "y", "z") for i, lb, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("values", [lambda r: r.gauss(0.1, 0.2), lambda r: float(r.randint(-1, 1)), lambda r: r.gauss(0, 9000.0)])
def test_against_all_scores(spark, monkeypatch, values):
    """Small integers give many ties; large ones need longs."""
    for name, n in (("_BLOCK", 7), ("_ANCHORS", 3), ("_SLICE", 23), ("_ROWS", 10)):
        monkeypatch.setattr(H, name, n)
    rnd = random.Random(8)
    rows = [(k, rnd.randint(0, 2), [values(rnd) for _ in range(rnd.choice([11, 11, 11, 9]))]) for k in range(160)]
    rows += [(k, 1, rows[5][2]) for k in range(200, 240)] + [rows[10]] * 30 + [(10, 2, rows[11][2]), (300, 1, []), (310, 9, [0.1] * 11)]
    data = H.labelled(table(spark, rows))
    want = slow([(r["vec_id"], r["label"], r["v"]) for r in data.collect()], lambda i: i % 10 == 0)
    got = Counter(tuple(r) for r in H.hard_negatives(data.where("vec_id % 10 = 0"), data).collect())
    assert got == want and len(want) > 100


def test_scores_from_bit_planes():
    rnd = np.random.default_rng(2)
    x, a = rnd.integers(-300, 300, (50, 13)), rnd.integers(-300, 300, (6, 13))
    assert (H.scores(H.bit_planes(x, 10), H.subset_sums(a, np.int32)) == x @ a.T).all()


def test_query_changes_every_seventh_label_and_passes_over_unfit_rows(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(k, rnd.randint(0, 9), [rnd.gauss(0.2, 0.3) for _ in range(16)]) for k in range(260)]
    odd = [(50, None, [1.0] * 16), (350, 3, None), (None, 3, [1.0] * 16), (400, 3, [None] * 16), (450, 3, [float("nan")] * 16)]
    table(spark, rows + odd).write.parquet(f"{tmp_path}/embeddings.parquet")
    kept = [(i, (lb + 1) % 10 if i % 7 == 0 else lb, [int(np.floor(float(np.float32(x)) * 256)) for x in v]) for i, lb, v in rows]
    got = H.op13_hard_negatives(spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(r) for r in got.collect()) == slow(kept, lambda i: i % 50 == 0)


def test_nothing_to_mine(spark):
    none = H.labelled(spark.createDataFrame([], SCHEMA))
    assert H.hard_negatives(none, none).collect() == []
    one = H.labelled(table(spark, [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.0])]))
    assert H.hard_negatives(one, one).collect() == []
