import random

import numpy as np
import pyarrow as pa

from tallyloom.llm import toxicity as X
from tallyloom.llm.arrow_text import column_bytes
from tallyloom.llm.language_id import held_out


def corpus(n=900):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(10, 80))]
        toxic = int(rnd.random() < 0.25)
        for _ in range(3 * toxic):
            text[rnd.randrange(len(text))] = rnd.choice(["vile", "Awful!", "nasty"])
        rows.append((i, " ".join(text), toxic))
    return rows


def slow_features(text, bits):
    """n-grams one by one, by the same hash of single words."""
    words = text.encode().lower().split()
    data = np.frombuffer(b" ".join(words), np.uint8)
    if not words:
        return set()
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    h = X.word_hashes(data, starts, np.array([len(w) for w in words]))
    shift = np.uint64(64 - bits)
    out = {int(x >> shift) for x in h}
    for k in range(len(h) - 1):
        out.add(int(X.chain(h[k : k + 1] ^ X._PAIR, h[k + 1 : k + 2])[0] >> shift))
    for k in range(len(h) - 2):
        out.add(int(X.chain(h[k : k + 1] ^ X._SKIP, h[k + 2 : k + 3])[0] >> shift))
    return out


def test_features():
    texts = ["One two THREE four", "", " x ", "a b", None, "longer-than-eight-bytes é\tüü\n end", "a " * 50]
    data, offsets = column_bytes(pa.array(texts))
    got = [set(f.tolist()) for f in X.features(data, offsets, 18)]
    assert got == [slow_features(t or "", 18) for t in texts]


def test_held_out_accuracy_and_sparse_weights(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus()], "doc_id long, toxic int")
    model = X.fit(X.training_rows(docs, labels))
    assert 0 < len(model[0]) < 5000
    rows = X.score(docs, model).where(held_out()).join(labels, "doc_id").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert len(rows) > 150 and right / len(rows) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def slow_ftrl(rows, labels, bits, alpha, beta, l1, l2, epochs):
    """The rule one coordinate at a time, in dictionaries."""
    z, n = {}, {}
    order = np.random.default_rng(7)
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= (l1 if k < 1 << bits else 0.0) else -(z[k] - np.sign(z[k]) * (l1 if k < 1 << bits else 0.0)) / ((beta + np.sqrt(n[k])) / alpha + l2)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            at = [*rows[r], 1 << bits]
            w = {k: weight(k) for k in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - labels[r]
            for k in at:
                sigma = (np.sqrt(n.get(k, 0.0) + g * g) - np.sqrt(n.get(k, 0.0))) / alpha
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = n.get(k, 0.0) + g * g
    return {k: weight(k) for k in z if weight(k)}


def test_training_follows_the_sequential_rule():
    rnd = np.random.default_rng(3)
    rows = [np.unique(rnd.integers(0, 64, 12)).astype(np.int32) for _ in range(60)]
    labels = np.array([int(r[0] < 4) for r in rows])
    slots, weights = X.train_shard(rows, labels, 8, 1.0, 1.0, 0.5, 1e-3, 3)
    want = slow_ftrl([r.tolist() for r in rows], labels, 8, 1.0, 1.0, 0.5, 1e-3, 3)
    assert dict(zip(slots.tolist(), np.round(weights, 9).tolist())) == {k: round(float(w), 9) for k, w in want.items()}


def test_sample_is_bounded_and_copies_count_once(spark):
    rows = [("same words again", 1)] * 3000 + [(f"text {i} of many", i % 2) for i in range(300)] + [("text 1 of many", 0), (None, 1), ("x", None)]
    docs = spark.createDataFrame(rows, "text string, label int")
    assert [X.sample(docs, most).count() for most in (100, 1000)] == [100, 302]


def test_repeated_ids_and_very_long_texts_are_learnt_from(spark):
    docs = spark.createDataFrame([(i % 50, f"vile stuff {i}" if i % 2 else "good " * 40000 + str(i)) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(7, 1), (7, None), (None, 1)], "doc_id long, toxic int")
    model = X.fit(X.training_rows(docs, labels))
    rows = X.training_rows(docs, labels).collect()
    assert sorted(r["text"] for r in rows) == sorted(r["text"] for r in docs.where(~held_out()).select("text").distinct().collect())
    assert all(r["label"] == int("good" not in r["text"]) for r in rows)
    assert X.training_rows(docs, labels, 7).count() == 7
    assert all(r["predicted"] == 1 for r in X.score(docs, model).where("text LIKE 'vile%'").collect())


def test_odd_rows_and_no_labels(spark):
    empty = spark.createDataFrame([], "text string, label int")
    model = X.fit(empty)
    rows = [(1, None, 5), (2, "", None), (None, "x " * 30000, 1), (2, "", None)]
    got = X.score(spark.createDataFrame(rows, "doc_id long, text string, score int"), model).collect()
    assert len(got) == 4 and all(0 <= r["score"] < 1e-9 and r["predicted"] == 0 for r in got)
    assert X.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    assert len(X.fit(spark.createDataFrame([("a", None), (None, 1), ("b", 7)], "text string, label int"))[0]) == 1
