import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import packing as P

ODD = ["a   b", "a  b", " a", " \n b", "a\n \nfoo", "a \nfoo\n\n bar ", "<|endoftext|>x <|endoftext|> y<|endoftext|>", "it's  I'LL 've\t\tx", " a   b", "日本 語 123 4a_b", "", "   ", "   x \x85 y", "a\x1c b", "²³ x² ½", None, "foo.\nBar, baz!? 12,5 l'été", "x" * 300, "a\u2003 \xa0b", "a\xa0 b c\u3000 d", "don't, o'clock. É."]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.vocabulary_path())


def texts(n=120):
    rnd = random.Random(6)
    alphabet = "abcdefgh   éßñ.,'\n\t日12_!"
    return ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 400))) for _ in range(n)]


@pytest.mark.parametrize("most", [200_000, 16])
def test_ids_are_those_of_the_library(library, most):
    coder = P.Encoder(P.vocabulary_path(), most_words=most)
    found = [t or "" for t in texts()]
    for at in range(0, len(found), 9):
        part = found[at : at + 9]
        flat, bounds = coder.encode(pa.array(part, pa.string()))
        assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [library.encode(t, add_special_tokens=False).ids for t in part]
    assert len(coder.spaced.words) <= most


def test_pieces_rebuild_documents_and_sequences_hold(spark, library):
    rows = [(i % 100, t, "x", 0) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, offset int")
    got = P.pack_documents(docs, window=64, with_ids=True).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 64):
            part = ids[at : at + 64]
            want[i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def best_fit(lengths, window):
    """Plain best-fit decreasing: the number of windows and what is left in each."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, c in enumerate(left) if c >= n]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= n
        else:
            left.append(window - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    lengths = [rnd.randint(1, 50) if rnd.random() < 0.7 else rnd.choice([50, 25, 7]) for _ in range(rnd.randint(0, 300))]
    places, ranks = {}, Counter()
    runs = P.plan(Counter(lengths).items(), 50)
    for length, first, end, sequence, each, at in runs:
        assert first == ranks[length]
        ranks[length] = end
        for r in range(end - first):
            places.setdefault(sequence + r // each, []).append((at + r % each * length, length))
    assert ranks == Counter(lengths)
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
    assert sorted(50 - sum(n for _, n in p) for p in places.values()) == best_fit(lengths, 50)


def test_empty_table(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
