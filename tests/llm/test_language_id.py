import math
import random
import zlib

import zstandard

from tallyloom.llm import language_id as L

SYLLABLES = {"aa": "ka ta ra mo ni lu", "bb": "sch ung keit der die ein", "cc": "ción ado mente gar ñes la"}


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang].split()) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def corpus(n=300):
    rnd = random.Random(2)
    return [(i, prose(rnd, lang := "aa bb cc".split()[i % 3], rnd.randint(20, 120)), lang) for i in range(n)]


def test_held_out_is_crc32(spark):
    ids = spark.range(200).withColumnRenamed("id", "doc_id")
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in ids.withColumn("h", L.held_out()).collect())


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert list(model.dictionaries) == ["aa", "bb", "cc"] and all(len(d) <= 112_640 for d in model.dictionaries.values())
    rows = L.predict(docs, model).where(L.held_out()).collect()
    assert len(rows) > 40 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_short_and_long_texts_and_copies_are_learnt_from(spark):
    rnd = random.Random(5)
    short = [(i, prose(rnd, "aa", 8), "aa") for i in range(0, 120)]  # under 200 characters
    long = [(i, prose(rnd, "bb", 1500), "bb") for i in range(200, 240)]  # over 6,000
    copies = [(i, prose(random.Random(i % 5), "cc", 60), "cc") for i in range(1000, 21000)]  # five texts
    docs = spark.createDataFrame(short + long + copies, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert list(model.dictionaries) == ["aa", "bb", "cc"]
    assert all(prose(random.Random(k), "cc", 60).lower().encode() in model.dictionaries["cc"] for k in range(5))
    assert 100_000 < len(model.dictionaries["bb"]) <= 112_640
    rows = L.predict(docs, model).where(L.held_out()).collect()
    assert all(sum(r["lang"] == r["lang_pred"] for r in rows if r["lang"] == x) >= 0.9 * sum(r["lang"] == x for r in rows) > 0 for x in SYLLABLES)


def test_odd_rows(spark):
    model = L.fit(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    rows = [(1, None, "x"), (2, "", None), (3, "123 !? \n", "y"), (4, "é", None), (None, prose(random.Random(1), "bb", 5000), "z"), (4, "é", None)]
    got = L.predict(spark.createDataFrame(rows, "doc_id long, text string, score string"), model, keep=["doc_id", "score"]).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and [by[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(by[i]["rejected"] for i in (1, 2, 3))
    assert by[4]["lang_pred"] in SYLLABLES and by[None]["lang_pred"] == "bb" and not by[None]["rejected"]


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = L.fit(none)
    assert model.dictionaries == {} and L.predict(none, model).count() == 0
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.predict(one, model).first()["lang_pred"] == "und"


def test_dictionaries_are_full_whatever_the_lengths_of_texts(spark):
    rnd = random.Random(8)
    rows = [(i, prose(rnd, "aa", 3), "aa") for i in range(8000)] + [(i, prose(rnd, "bb", 3000), "bb") for i in range(8000, 8300)] + [(i, prose(rnd, "cc", 30), "cc") for i in range(9000, 9020)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dict_bytes=30_000, slice_chars=500)
    sizes = {k: len(v) for k, v in model.dictionaries.items()}
    assert sizes["aa"] == sizes["bb"] == 30_000 and 1000 < sizes["cc"] < 10_000


def test_predictions_are_those_of_a_plain_loop(spark):
    """Every text, cut into blocks, compressed with each dictionary by the library itself."""
    docs = spark.createDataFrame(corpus(60) + [(900, "kachung " * 700, None), (901, "é", None)], "doc_id long, text string, lang string")
    model = L.fit(docs)
    got = {r["doc_id"]: r for r in L.predict(docs, model).collect()}
    for r in docs.collect():
        raw, sizes = r["text"].lower().encode(), {}
        for k, words in model.dictionaries.items():
            data = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(level=model.level, dict_data=data, write_content_size=False, write_dict_id=False)
            sizes[k] = sum(len(coder.compress(raw[at : at + 2048])) for at in range(0, len(raw), 2048))
        best = min(sizes, key=lambda k: (sizes[k], k))
        assert got[r["doc_id"]]["lang_pred"] == best
        assert abs(got[r["doc_id"]]["score"] - 1 / sum(math.exp((sizes[best] - n) / 8) for n in sizes.values())) < 1e-12
