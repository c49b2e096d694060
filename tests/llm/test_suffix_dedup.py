import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import suffix_dedup as S


def brute(rows, size):
    """(id, n_bytes, n_removed, n_spans, sha256) by counting every window."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[p : p + size] for _, r in raws for p in range(len(r) - size + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r) + 2, np.int8)
        for p in range(len(r) - size + 1):
            if seen[r[p : p + size]] > 1:
                gone[p + 1 : p + size + 1] = 1
        kept = bytes(b for b, g in zip(r, gone[1:]) if not g)
        out.append((i, len(r), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fixture(seed=3, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(30), prose(12), "na " * 60, "x" * 150]
    rows = []
    for i in range(n):
        parts = [prose(rnd.randint(0, 25)) for _ in range(3)]
        for _ in range(rnd.randint(0, 2)):
            s = rnd.choice(shared)
            cut = rnd.randint(0, len(s) // 2)
            parts.insert(rnd.randint(0, 3), s[cut:] if rnd.random() < 0.5 else s[: len(s) - cut])
        rows.append((i, " ".join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "short"), (5, rows[5][1]), (None, rows[7][1]), (n + 3, rows[7][1]), (n + 4, "né" * 90)]
    return rows


@pytest.mark.parametrize("most", [20_000, 1])
def test_against_brute_force(spark, most):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, h string, k1 int")
    got = S.remove_repeats(docs, size=40, gram=10, most=most, keep=["doc_id"]).drop("left").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 40)


def test_parts_of_a_segment_hold_each_window_once():
    rnd = np.random.default_rng(2)
    seg = rnd.integers(97, 101, 70).astype(np.uint8)
    for place in (0, 13, 30):  # an anchor of 10 bytes in windows of 40
        cut = seg[: place + 40]
        for width in (8, 4, 1):
            start, length, at, group, part = S.narrower(cut, place, np.uint64(5), width, size=40)
            assert sorted(p for s, n in zip(start, length) for p in range(s, s + n - 39)) == list(range(len(cut) - 39))
            assert (start + at == place).all() and (length - 39 <= width).all()


def test_runs_with_few_words_stay(spark):
    words = [f"w{i}" for i in range(500)]
    many, few, solid = " ".join(words[:60]), " ".join(w * 8 for w in words[100:112]), "字" * 140
    rows = [(0, f"aa {many} bb"), (1, f"cc {many} dd"), (2, f"ee {few} ff"), (3, f"gg {few} hh"), (4, f"ii {solid}"), (5, f"jj {solid}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"]: r["left"] for r in S.remove_repeats(docs, size=200, gram=64, least_words=51).collect()}
    assert left == {0: "aabb", 1: "ccdd", 2: rows[2][1], 3: rows[3][1], 4: "ii", 5: "jj"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(docs).count() == 0


def test_long_rows_are_read_in_parts():
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 101, 5000).astype(np.uint8)
    covered = []
    for row, start, length, place, h, fp, number, reach in S.long_rows(data, np.array([0, 5000]), size=40, gram=10, chunk=512):
        covered += [p for s, n, more in zip(start, length, reach) for p in range(s, s + more + n - 39)]
    assert sorted(covered) == list(range(5000 - 39))


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_texts_without_a_common_window_stay_whole_however_alike_their_hashes(spark):
    """Polynomial hashes modulo 2**64 can't tell these parts from each other."""
    rnd = random.Random(6)
    one, two = thue_morse(256, "ab"), thue_morse(256, "ba")
    middle = "".join(rnd.choice("cdefgh ") for _ in range(128))
    rows = [(0, one + middle + two), (1, two + middle + one)]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).drop("left").collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 400) and all(r["n_removed"] == 0 for r in got)


def test_periodic_texts_against_brute_force_at_full_size(spark):
    rnd = random.Random(7)
    prose = lambda k: "".join(rnd.choice("abcdefgh ") for _ in range(k))
    rows = [(0, "z" * 3000), (1, prose(500) + "na " * 300 + prose(200)), (2, "na " * 140 + prose(450)), (3, "z" * 400), (4, "y" * 400), (5, "abcabcabcd" * 90), (6, prose(100) + "y" * 401), (7, thue_morse(3000, "ab")), (8, "z" * 399 + "é" * 500)]
    long = prose(700)
    rows += [(20, prose(50) + long), (21, long + prose(90)), (22, (long[:450] + "-") * 8)]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).drop("left").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 400)


def test_a_long_text_of_one_letter_is_a_few_rows():
    data = np.full(10_000_000, 122, np.uint8)
    rows = [(int(n), int(s), int(s + more + size)) for _, start, length, _, _, _, number, reach in S.long_rows(data, np.array([0, len(data)])) for n, s, more, size in zip(number, start, reach, length)]
    assert len(rows) < 30 and sum(n for n, _, _ in rows) == len(data) - 399
    assert min(s for _, s, _ in rows) == 0 and max(e for _, _, e in rows) == len(data)
