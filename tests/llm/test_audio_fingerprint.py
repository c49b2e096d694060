import numpy as np
import pytest

from tallyloom.llm import audio_fingerprint as A


def slow_packed(image):
    """The filters by summing areas cell by cell."""
    out = []
    for t in range(len(image) - A.SPAN + 1):
        value = 0
        for kind, y, h, w in A.filters():
            box = image[t : t + w, y : y + h]
            top, half = h // 2, w // 2
            if kind == 0:
                a, b = box.sum(), (image[t : t + w].sum() - box.sum()) * h / (12 - h)
            elif kind == 1:
                a, b = box[:, :top].sum() / top, box[:, top:].sum() / (h - top)
            elif kind == 2:
                a, b = box[:half].sum(), box[half:].sum()
            else:
                a, b = box[:half, :top].sum() + box[half:, top:].sum(), box[half:, :top].sum() + box[:half, top:].sum()
            level = int(np.searchsorted((-0.25, 0.0, 0.25), np.log1p(max(a, 0)) - np.log1p(max(b, 0))))
            value = value << 2 | (level ^ level >> 1)
        out.append(value)
    return out


def tune(seed, n):
    return A._NOTES[np.random.default_rng(seed).integers(0, 36, n)].ravel()


def chroma(sound):
    return A.chromas([[sound]])[0]


def pcm(x):
    return (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()


def test_integral_image_filters():
    image = chroma(tune(1, 60))
    assert np.abs(np.linalg.norm(image / 2**20, axis=1) - 1).max() < 1e-5
    assert (A.packed(image) == np.array(slow_packed(image / 2**20), np.uint32)).all()


def test_equal_sounds_are_equal_anywhere():
    sounds = [tune(k, n) for k, n in enumerate([60, 1, 300, 15, 2, 17])] + [np.zeros(0)]
    image, sizes = A.chromas([s] for s in sounds)
    starts = np.cumsum(sizes) - sizes
    for sound, at, n in zip(sounds, starts, sizes):
        pieces = np.array_split(sound, 7)
        assert (image[at : at + n] == chroma(sound)).all() and (A.chromas([pieces])[0] == chroma(sound)).all()
    assert sizes.tolist()[-1] == A.SPAN


def test_pieces_of_a_long_text(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(700))
    whole = np.concatenate(list(A.melody(text)))
    monkeypatch.setattr(A, "_PIECE", 50)
    assert (np.concatenate(list(A.melody(text))) == whole).all() and len(whole) == 700 * A.HOP


def test_many_offsets_at_once():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 2**32, 300).astype(np.uint32), rng.integers(0, 2**32, 200).astype(np.uint32)
    offsets = np.arange(-199, 300)
    overlap, error = A.bit_errors(a, b, offsets)
    one = [A.bit_error(a, b, int(o)) for o in offsets]
    assert overlap.tolist() == [o for o, _ in one] and np.allclose(error, [e for _, e in one])
    assert overlap.sum() > 64 * 512 // 1  # the way by correlation


def test_against_all_pairs_and_offsets(spark):
    rng = np.random.default_rng(7)
    base = [tune(10 + k, 100) for k in range(8)]
    sounds = list(base)
    for k, noise in enumerate([0.02, 0.05, 0.1, 0.2, 0.3, 0.4]):
        part = base[k][(5 + k) * A.HOP + 40 * k :][: 70 * A.HOP]
        sounds.append(part + rng.normal(0, noise, len(part)))
    changed = base[6].reshape(-1, A.HOP).copy()
    changed[::12] = A._NOTES[rng.integers(0, 36, len(changed[::12]))]
    sounds.append(changed.ravel())
    df = spark.createDataFrame([(k, pcm(s)) for k, s in enumerate(sounds)], "rec long, sound binary")
    prints = {r["class_id"]: np.frombuffer(r["fingerprint"], "<u4") for r in A.fingerprints(df, "sound", ["rec"]).collect()}
    table = spark.createDataFrame([(c, p.tobytes()) for c, p in prints.items()], "class_id long, fingerprint binary")
    brute = {}
    for a, x in prints.items():
        for b, y in prints.items():
            tried = [(e, -n, o) for o in range(-len(y) + 1, len(x)) for n, e in [A.bit_error(x, y, o)] if n >= A.SPAN]
            if a != b and min(tried)[0] <= 0.2:
                brute[a, b] = min(tried)
    got = {(r["query_class"], r["match_class"]): (r["bit_error"], -r["overlap"], r["offset"]) for r in A.align(table, table).collect()}
    assert len(brute) >= 10 and set(got) <= set(brute)
    assert len(got) >= 0.9 * len(brute)
    assert all(got[k] == brute[k] for k in got)


def test_alignment_and_odd_rows(spark):
    long, other = tune(2, 120), tune(3, 90)
    noisy = long[20 * A.HOP : 100 * A.HOP] + np.random.default_rng(4).normal(0, 0.01, 80 * A.HOP)
    rows = [(1, pcm(long)), (2, pcm(noisy)), (3, pcm(other)), (4, pcm(long)), (5, None), (6, b""), (7, b"\x01"), (8, pcm(tune(5, 3)))]
    recordings = spark.createDataFrame([(i, s, "x") for i, s in rows], "rec long, sound binary, fingerprint string")
    prints = A.fingerprints(recordings, "sound", ["rec"]).cache()
    ids = {r["rec"]: r["class_id"] for r in prints.collect()}
    assert ids[1] == ids[4] and ids[5] == ids[6] == ids[7] and len(set(ids.values())) == 5
    classes = prints.groupBy("class_id").agg({"fingerprint": "first"}).toDF("class_id", "fingerprint")
    got = {(r["query_class"], r["match_class"]): r for r in A.align(classes, classes.where(f"class_id = {ids[1]}")).collect()}
    assert list(got) == [(ids[1], ids[2])]
    hit = got[ids[1], ids[2]]
    assert hit["offset"] == 20 and hit["bit_error"] < 0.1 and hit["overlap"] > 50


def test_empty_table(spark):
    e = spark.createDataFrame([], "conv_id long, turn int, text string")
    assert A.fingerprints(e, "text", ["conv_id"], A.melody).count() == 0
    prints = spark.createDataFrame([(None, b"1234"), (1, None), (2, b"")], "class_id long, fingerprint binary")
    assert A.align(prints, prints).count() == 0 and A.align(prints.limit(0), prints).count() == 0
    with pytest.raises(ValueError):
        A.fingerprints(e.withColumnRenamed("turn", "n_frames"), "text", ["n_frames"], A.melody)
