import random
from collections import Counter
from itertools import groupby

import pyarrow as pa
import pytest

import corpus_pipeline as C
from tallyloom.llm import minhash_dedup, suffix_dedup
from tallyloom.llm.language_id import held_out

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "language_id", "near_dedup", "suffix_dedup", "packing"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    now = docs
    for name, stage in C.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        now = stage(spark, now, SF).cache()
        after = {r["doc_id"]: r["text"] for r in now.collect()}
        assert now.columns == docs.columns and after.keys() <= before.keys()
        if name == "near_dedup":
            assert after.keys() == {r["doc_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(list(before.items()), "doc_id long, text string"), width=5, percent=80).where("kept").collect()}
        elif name == "suffix_dedup":
            assert after.keys() == before.keys()
            left = suffix_dedup.remove_repeats(spark.createDataFrame(list(before.items()), "doc_id long, text string"), keep=["doc_id"], size=200, gram=64, least_words=51)
            assert after == {r["doc_id"]: r["left"] for r in left.collect()}
        else:
            assert len(after) >= 0.8 * len(before)
            known = now.where(~held_out()).select("doc_id").collect() if name == "toxicity" else []
            assert not known or sum(labels.get(r["doc_id"], 0) for r in known) <= 0.05 * len(known)
    packed = C.STAGES[-1][1](spark, now, SF).collect()
    assert {r["doc_id"] for r in packed} == set(after)


def test_odd_rows_through_all_stages(spark):
    """Nulls in every column, repeated ids and rows, very long texts, extra columns with the stages' own names."""
    base = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    long = " ".join(t for _, t, *_ in base[:40]) * 6
    odd = [(None, base[0][1], None, None, None), (base[1][0], base[1][1], "en", "x", 1), (base[1][0], base[2][1], "en", "x", 1), (9001, None, "en", "x", 0), (9002, "", None, "x", 0), (9003, long, "en", "x", 5), (9003, long, "en", "x", 5), (None, None, None, None, None)]
    rows = [(*r, "s", 1) for r in base + odd]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, kept int")
    now = docs
    for name, stage in C.STAGES[:-1]:
        before = now.count()
        now = stage(spark, now, SF).cache()
        assert now.columns == docs.columns and now.count() <= before
        if name == "toxicity":
            assert now.where("doc_id = 9001 AND text IS NULL").count() == 1 and now.where("doc_id IS NULL").count() == 2
        if name == "language_id":  # texts without a letter have no language
            assert now.where("text IS NULL OR text = ''").count() == 0 and now.where("doc_id IS NULL").count() == 1
        if name == "near_dedup":  # rows that share an id stay or go together
            assert now.where("doc_id = 9003").count() in (0, 2)
    packed = C.STAGES[-1][1](spark, now, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in now.collect()}


def test_near_dedup_stage_against_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(30):
        words = [f"w{rnd.randint(0, 5000)}" for _ in range(100)]
        rows.append((3 * k, " ".join(words)))
        rows.append((3 * k + 1, " ".join(words + [f"v{rnd.randint(0, 5000)}" for _ in range(rnd.choice([10, 20, 24, 25, 40]))])))
        rows.append((3 * k + 2, " ".join(words[: rnd.choice([95, 82, 80, 60])])))
    grams = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in rows)}
    root = {d: d for d in grams}
    for a in grams:
        for b in grams:
            if a < b and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {d: lo if r == hi else r for d, r in root.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in C.drop_near_copies(spark, docs, SF).collect()} == {d for d, r in root.items() if d == r}


def test_repeats_stage_against_brute_force(spark):
    """Passages of 45 to 70 words in documents of their own words, some with an edited word: what goes is counted window by window."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    passages = [[word() for _ in range(n)] for n in (45, 51, 52, 60, 70) for _ in range(3)]
    rows = []
    for k in range(60):
        passage = list(passages[k % len(passages)])
        if k % 7 == 0:
            passage[rnd.randrange(len(passage))] = word()
        rows.append((k, " ".join([word() for _ in range(rnd.randint(5, 60))] + passage + [word() for _ in range(rnd.randint(5, 60))])))
    windows = Counter(t[p : p + 200] for _, t in rows for p in range(len(t) - 199))
    expected = {}
    for k, t in rows:
        gone = [False] * len(t)
        for p in range(len(t) - 199):
            if windows[t[p : p + 200]] > 1:
                gone[p : p + 200] = [True] * 200
        left, at = [], 0
        for dead, run in groupby(range(len(t)), key=lambda p: gone[p]):
            part = "".join(t[p] for p in run)
            left.append("" if dead and (len(part.split()) > 50 or len(part) >= 400) else part)
        expected[k] = "".join(left)
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in rows], "doc_id long, text string, n_chars long")
    got = C.cut_repeats(spark, docs, SF).collect()
    assert {r["doc_id"]: r["text"] for r in got} == expected and all(r["n_chars"] == len(r["text"]) for r in got)
    assert 20 < sum(expected[k] != t for k, t in rows) < 60


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in C.STAGES])
def test_batches_of_long_texts_are_bounded(spark, stage):
    """600 texts of 100 kB are 60 MB, in one batch of under 10,000 rows before."""
    session = spark.newSession()
    texts = session.range(0, 600, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 20000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    stage(session, session.read.parquet(f"{SF}/documents.parquet").where("false"), SF)
    got = texts.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 600 and max(r["bytes"] for r in got) < 6_000_000


def test_a_session_keeps_its_own_batches(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64k")
    docs = session.read.parquet(f"{SF}/documents.parquet")
    small = sorted(tuple(r) for r in C.drop_toxic(session, docs, SF).collect())
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "64k"
    again = spark.newSession()
    assert small == sorted(tuple(r) for r in C.drop_toxic(again, again.read.parquet(f"{SF}/documents.parquet"), SF).collect())
