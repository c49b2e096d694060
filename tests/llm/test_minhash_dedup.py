import random
import re

import numpy as np
import pytest

from tallyloom.llm import minhash_dedup as D


def brute(rows, percent=85, width=3):
    sets = []
    for _, t in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=1):
    rnd = random.Random(seed)
    prose = lambda n: [rnd.choice("alpha beta gamma delta Éta zeta eta theta iota kappa".split()) + str(rnd.randint(0, 60)) for _ in range(n)]
    rows, base = [], [prose(n) for n in (40, 120, 300)]
    for words in base:
        for k in range(40):
            w = list(words)
            for _ in range(rnd.randint(0, len(w) // 12)):
                w[rnd.randrange(len(w))] = "x" + str(rnd.randint(0, 999))
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "one  two\n"), (907, "a b c"), (908, "A\tB c"), (None, "a b c"), (907, "a b c"), (3, rows[50][1]), (910, "x " * 500), (911, "x x x")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "y", 1) for i, t in rows], "doc_id long, text string, band string, n int")
    assert sorted((tuple(r) for r in D.near_duplicates(docs).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("width", [1, 2, 5])
def test_other_widths_and_thresholds(spark, width):
    rows = corpus(3)[::2]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in D.near_duplicates(docs, percent=80, width=width).collect()), key=str) == brute(rows, 80, width)


def test_a_large_group_that_shares_a_passage(spark):
    """Copies of a passage with more or fewer words of their own: most are no copies of each other."""
    rnd = random.Random(7)
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join([*passage, *(f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([0, 2, 5, 8, 10, 12, 20, 60])))])) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in D.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_two_sums_stand_for_a_set():
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64)) for n in range(1, 300)]
    one, two = zip(*(D.set_sums(s) for s in sets))
    assert len(set(one)) == len(set(two)) == len(sets)
    assert all(D.set_sums(s[::-1]) == (a, b) for s, a, b in zip(sets, one, two))
    # sets made to agree in the first sum differ in the second
    x, y, z = (int(v) for v in D.mix64(rnd.integers(0, 1 << 63, 3, dtype=np.uint64)))
    assert len({int(D.mix64(np.array([v], np.uint64) ^ D._SECOND)[0]) for v in (x, y, z, (x + y - z) % (1 << 64))}) == 4


def test_parity_bits_never_say_more_than_the_sets():
    rnd = np.random.default_rng(6)
    for _ in range(200):
        a, b = (np.unique(rnd.integers(0, 1 << 63, rnd.integers(1, 900)).astype(np.uint64)) for _ in range(2))
        b = np.union1d(b[: rnd.integers(0, 40)], a)
        d = len(np.setxor1d(a, b))
        assert np.bitwise_count((D.parity_bits(a) ^ D.parity_bits(b)).view(np.uint64)).sum() <= d


def test_kept_rows_have_all_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", "p"), (2, "a b c d", "q"), (3, "e f g", None)], "doc_id long, text string, kept string")
    assert sorted(tuple(r) for r in D.one_of_each(docs).collect()) == [(1, "a b c d", "p"), (3, "e f g", None)]


def test_bound_keeps_what_it_promises():
    rnd = np.random.default_rng(2)
    same = rnd.random((20000, 96)) < 0.85
    a = np.zeros((20000, 96), np.uint32)
    assert len(D.survivors(a, np.where(same, 0, 1).astype(np.uint32), 0.85, 1e-6)) >= 19990
    low = rnd.random((20000, 96)) < 0.4
    assert len(D.survivors(a, np.where(low, 0, 1).astype(np.uint32), 0.85, 1e-6)) < 200


def test_empty_table(spark):
    assert D.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
