import random

import pyarrow as pa
import pytest

from tallyloom.llm import piece_codec as P

ODD = ["", " ", "  a", "a  b ", "a\tb\n\nc", "ﬁ ①", "日本 　x", "​ a", "é", "<s> </s> <unk> <0x0A>", "\x00a", "▁a▁▁b", "a\xa0b", "x" * 200, "ab " * 30, "𝔘𝔫🙂🙂 ok", None, "a    b     c", "ÉLEOI!! ÇA"]


def mixed(n=150):
    rnd = random.Random(4)
    alphabet = "abcdefgh  éßñ.,\n日本ΩЖ🙂"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.vocabulary_path())


def test_whole_texts_against_the_library(spark, library):
    texts = ODD + mixed()
    docs = spark.createDataFrame([(i, t, "x", 2) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n int")
    for r in P.encode_decode(docs).collect():
        ids = library.encode(texts[r["doc_id"]] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids)


def test_both_agendas_agree():
    v = P.PieceVocabulary(P.vocabulary_path())
    words = sorted({w for t in mixed(400) for w in t.split(" ") if 0 < len(w) < 30})
    flat, sizes = v.ids_of(words)
    assert flat.tolist() == [i for w in words for i in v.to_ids(w, v.agenda(w))] and sizes.sum() == len(flat)


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_full_memory_keeps_results(library, most):
    c = P.Codec(P.vocabulary_path(), most=most)
    texts = [t or "" for t in ODD] + mixed(60)
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        flat, bounds = c.encode(pa.array(part, pa.string()))
        assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [library.encode(t) for t in part]
        assert len(c.memory.words) <= most


def test_a_difference_from_the_library_is_an_error():
    c = P.Codec(P.vocabulary_path())
    c.vocabulary.joined = c.vocabulary.joined[::-1].copy()
    with pytest.raises(RuntimeError, match="the agenda gives"):
        c.encode(pa.array(["certainly different words"]))


def test_empty_table(spark):
    assert P.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
