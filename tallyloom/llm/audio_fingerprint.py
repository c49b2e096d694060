"""Chroma fingerprints of recordings, and their alignment.

A recording's power spectrum, frame by frame, is folded into twelve pitch classes and
smoothed.  Sixteen filters compare areas of this image by its integral image; each gives
two bits, so every frame gives one packed 32-bit integer.  Recordings with equal
fingerprints form a class.  Classes that share an integer but for one bit, and most bits of
those eight frames before and after it, are candidates; a histogram counts the offsets at
which they do, and the share of differing bits over the whole overlap decides which offset
holds, if any.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import saved

RATE, FRAME, HOP = 4000, 1024, 512
#: Frames that a filter looks at, and frames from an integer to those that are looked at beside it.
SPAN, STEP = 16, 8
#: Bits in which the integers on both sides of a shared one may differ, of 64.
_AROUND = 16
_SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: Steps between two areas: quotients of e^-0.25, 1 and e^0.25.
_STEPS = tuple(np.exp((-0.25, 0.0, 0.25)))
#: Frames that are transformed at once, tones or hops in a piece of sound, and sounds whose images stand together.
_BLOCK, _PIECE, _SOUNDS = 512, 2048, 128


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, height, width) of the sixteen filters.

    By rule: kinds 0 to 3 in turn (an area; upper against lower half; earlier against later
    half; checkerboard), with heights 3 to 6 and widths 4 to 16, the pitch class moving on by five.
    """
    return [(k % 4, 5 * k % (12 - (3 + k // 4)), 3 + k // 4, (4, 8, 12, 16)[(k + k // 4) % 4]) for k in range(16)]


def _bins(rate: int, frame: int) -> np.ndarray:
    """Pitch class of each spectrum bin, as a matrix; bins under 60 Hz have none."""
    hertz = np.arange(1, frame // 2 + 1) * rate / frame
    out = np.zeros((frame // 2 + 1, 12))
    heard = np.flatnonzero(hertz >= 60)
    out[heard + 1, np.round(12 * np.log2(hertz[heard] / 440)).astype(int) % 12] = 1
    return out


def frames_of(pieces: Iterable[np.ndarray], frame: int = FRAME, hop: int = HOP) -> Iterator[np.ndarray]:
    """Frames of a sound that comes in pieces, as rows; what is shorter than ``SPAN`` frames ends in silence."""
    left, n = np.zeros(0), 0
    for piece in pieces:
        left = np.concatenate([left, piece])
        if len(left) >= frame:
            rows = np.lib.stride_tricks.sliding_window_view(left, frame)[::hop]
            yield rows
            n += len(rows)
            left = left[len(rows) * hop :]
    if n < SPAN:
        left = np.concatenate([left, np.zeros((SPAN - 1 - n) * hop + frame - len(left))])
        yield np.lib.stride_tricks.sliding_window_view(left, frame)[::hop]


def powers(rows: Iterable[np.ndarray], rate: int = RATE, frame: int = FRAME) -> Iterator[np.ndarray]:
    """Power by pitch class of frames, ``_BLOCK`` at a time, whichever sounds they belong to.

    Every block has the same shape, so a frame's values do not depend on its neighbours.
    """
    window, fold = np.hanning(frame), np.repeat(_bins(rate, frame), 2, axis=0)  # real and imaginary parts in turn
    block, n = np.zeros((_BLOCK, frame)), 0

    def folded() -> np.ndarray:
        parts = np.fft.rfft(block, axis=1).view(float)
        return np.multiply(parts, parts, out=parts) @ fold

    for some in rows:
        at = 0
        while at < len(some):
            take = min(_BLOCK - n, len(some) - at)
            np.multiply(some[at : at + take], window, out=block[n : n + take])
            n, at = n + take, at + take
            if n == _BLOCK:
                yield folded()
                n = 0
    if n:
        yield folded()[:n]


def chromas(sounds: Iterable[Iterable[np.ndarray]], rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> tuple[np.ndarray, np.ndarray]:
    """(image, lengths): the smoothed frames of all sounds one below the other, by pitch class, and how many each sound has.

    A frame has length 1 (silence: 0), in whole steps of 2^-20, so that sums of areas are exact
    and equal sounds have equal fingerprints wherever they stand.
    """
    lengths: list[int] = []

    def rows() -> Iterator[np.ndarray]:
        for sound in sounds:
            lengths.append(0)
            for some in frames_of(sound, frame, hop):
                lengths[-1] += len(some)
                yield some

    found = list(powers(rows(), rate, frame))
    sizes = np.array(lengths, np.int64)
    raw = np.concatenate(found) if found else np.zeros((0, 12))
    # two silent rows around every sound, so that smoothing stays within it
    place = np.arange(len(raw)) + 2 + 2 * np.repeat(np.arange(len(sizes)), sizes)
    padded = np.zeros((len(raw) + 2 * len(sizes) + 2, 12))
    padded[place] = raw
    image = sum(w * padded[k : k + len(padded) - 4] for k, w in enumerate(_SMOOTH))[place - 2]
    norms = np.linalg.norm(image, axis=1, keepdims=True)
    unit = np.divide(image, norms, out=np.zeros_like(image), where=norms > 1e-9)
    return np.rint(unit * (1 << 20)).astype(np.int64), sizes


def packed(image: np.ndarray) -> np.ndarray:
    """An unsigned 32-bit integer for each frame from which ``SPAN`` frames follow."""
    n = max(0, image.shape[0] - SPAN + 1)
    if not n:
        return np.zeros(0, np.uint32)
    total = np.zeros((13, image.shape[0] + 1), np.int64)
    total[1:, 1:] = image.T.cumsum(axis=0).cumsum(axis=1)

    def area(t: int, y: int, w: int, h: int) -> np.ndarray:
        return (total[y + h, t + w : t + w + n] - total[y + h, t : t + n]) - (total[y, t + w : t + w + n] - total[y, t : t + n])

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        top, half = h // 2, w // 2
        if kind == 0:
            own = area(0, y, w, h)
            a, b = own, (area(0, 0, w, 12) - own) * (h / (12 - h))
        elif kind == 1:
            a, b = area(0, y, w, top) / top, area(0, y + top, w, h - top) / (h - top)
        elif kind == 2:
            a, b = area(0, y, half, h), area(half, y, w - half, h)
        else:
            a = area(0, y, half, top) + area(half, y + top, w - half, h - top)
            b = area(half, y, w - half, top) + area(0, y + top, half, h - top)
        a, b = a + float(1 << 20), b + float(1 << 20)
        level = sum((a > step * b).astype(np.uint32) for step in _STEPS)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def pcm16(data: bytes) -> Iterator[np.ndarray]:
    """Pieces of little-endian 16-bit mono sound."""
    whole = np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    for at in range(0, len(whole), _PIECE * HOP):
        yield whole[at : at + _PIECE * HOP] / 32768.0


def _notes() -> np.ndarray:
    """Three octaves of tones, each ``HOP`` samples long."""
    hertz = 220 * 2 ** (np.arange(36) / 12)
    time = np.arange(HOP) / RATE
    return np.sin(2 * np.pi * hertz[:, None] * time) * np.hanning(HOP)


_NOTES = _notes()


def melody(text: str) -> Iterator[np.ndarray]:
    """A text as sound: a tone for each word, its pitch by the word's hash.  Stands in for recordings, which no table has."""
    words = re.finditer(r"\S+", text)
    while pitches := [zlib.crc32(w.group().encode()) % 36 for w in itertools.islice(words, _PIECE)]:
        yield _NOTES[pitches].ravel()


def fingerprints(recordings: DataFrame, sound: str, keep: list[str], samples: Callable = pcm16) -> DataFrame:
    """The columns in ``keep``, fingerprint (binary, 4 bytes a frame), n_frames and class_id (a hash of it).

    ``samples`` turns a value of the column ``sound`` into pieces of samples; null is no sound.
    Sound that is shorter than a filter's span has one integer.  Equal sounds of a batch are
    worked out once; long ones pass through in pieces.  Names in ``keep`` may not be those of
    the three new columns.
    """
    clash = {"fingerprint", "n_frames", "class_id"} & set(keep)
    if clash:
        raise ValueError(f"columns of the result's names can't be kept: {sorted(clash)}")
    schema = T.StructType([*(recordings.schema[c] for c in keep), *T._parse_datatype_string("fingerprint binary, n_frames int, class_id long").fields])

    def prints_of(raws: list) -> Iterator[bytes]:
        for at in range(0, len(raws), _SOUNDS):
            image, sizes = chromas(samples(raw) if raw else () for raw in raws[at : at + _SOUNDS])
            codes, starts = packed(image).astype("<u4"), np.cumsum(sizes) - sizes
            for start, n in zip(starts, sizes):
                yield codes[start : start + n - SPAN + 1].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sounds = batch.column(len(keep)).dictionary_encode()
            kinds = list(prints_of([*sounds.dictionary.to_pylist(), None]))  # the last one is that of nulls
            ids = [int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little", signed=True) for p in kinds]
            of = sounds.indices.fill_null(len(kinds) - 1)
            columns = [pa.array(kinds, pa.binary()).take(of), pa.array([len(p) // 4 for p in kinds], pa.int32()).take(of), pa.array(ids, pa.int64()).take(of)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *columns], names=schema.names)

    return recordings.select(*keep, F.col(sound).alias("__sound")).mapInArrow(run, schema)


def _keys(batches: Iterator[pa.RecordBatch], flipped: bool) -> Iterator[pa.RecordBatch]:
    """(class_id, key, around, at): a row for each run of equal integers, and with ``flipped`` also one for each bit that could be wrong.

    around holds the integers ``STEP`` frames before and after (or the first and the last one).
    """
    wrong = np.concatenate([[0], 1 << np.arange(32)] if flipped else [[0]]).astype(np.int64)
    for batch in batches:
        ids = batch.column("class_id").to_numpy()
        for at in range(0, batch.num_rows, _SOUNDS):
            prints = [np.frombuffer(p.as_py(), "<u4") for p in batch.column("fingerprint")[at : at + _SOUNDS]]
            sizes = np.array([len(p) for p in prints])
            end = np.repeat(np.cumsum(sizes), sizes)
            start = end - np.repeat(sizes, sizes)
            code = np.concatenate(prints).astype(np.int64)
            place = np.arange(len(code))
            around = (code[np.maximum(place - STEP, start)] << 32) | code[np.minimum(place + STEP, end - 1)]
            first = np.flatnonzero((place == start) | (code != np.roll(code, 1)))
            for part in range(0, len(first), 1 << 14):
                some = first[part : part + (1 << 14)]
                columns = [np.repeat(ids[at : at + _SOUNDS], sizes)[some], around[some], (some - start[some]).astype(np.int32)]
                own, beside, frame = (pa.array(np.repeat(c, len(wrong))) for c in columns)
                yield pa.RecordBatch.from_arrays([own, pa.array((code[some, None] ^ wrong).ravel()), beside, frame], names=["class_id", "key", "around", "at"])


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """(frames, share of differing bits) where b, moved on by offset, lies over a."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 0, 1.0
    return hi - lo, float(np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).sum(dtype=np.int64)) / (32 * (hi - lo))


def bit_errors(a: np.ndarray, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``bit_error`` of many offsets; where they are very many, from one correlation a bit, for all offsets at once."""
    overlap = np.maximum(0, np.minimum(len(a), len(b) + offsets) - np.maximum(0, offsets))
    size = 1 << int(len(a) + len(b)).bit_length()
    if overlap.sum() < 64 * size:
        return overlap, np.array([bit_error(a, b, int(o))[1] for o in offsets])
    same = np.zeros(size // 2 + 1, complex)
    for k in range(32):
        x, y = (((v >> np.uint32(k)) & np.uint32(1)) * 2.0 - 1.0 for v in (a, b))
        same += np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size))
    agree = np.rint(np.fft.irfft(same, size))[offsets % size]  # equal less differing bits
    return overlap, np.where(overlap > 0, 0.5 - agree / np.maximum(64 * overlap, 1), 1.0)


def best_offset(a: np.ndarray, b: np.ndarray, offsets: np.ndarray, votes: np.ndarray, least_overlap: int) -> tuple[int, int, int, float] | None:
    """(offset, votes, overlap, bit error) of least error, then of most overlap and the smallest offset.

    Every offset of the histogram is tried, and those beside it, as noise may move a run's
    start by a frame; votes are those of the offset and of those beside it.
    """
    tried = np.unique(offsets[:, None] + np.arange(-1, 2))
    overlap, error = bit_errors(a, b, tried)
    fine = np.flatnonzero(overlap >= least_overlap)
    if not len(fine):
        return None
    k = fine[np.lexsort((tried[fine], -overlap[fine], error[fine]))[0]]
    near = np.abs(offsets - tried[k]) <= 1
    return int(tried[k]), int(votes[near].sum()), int(overlap[k]), float(error[k])


def align(prints: DataFrame, queries: DataFrame, most_error: float = 0.2, least_overlap: int = SPAN) -> DataFrame:
    """query_class, match_class, offset, votes, overlap, bit_error of the classes that lie over a query class.

    prints has class_id and fingerprint, a row a class; queries has class_id.  offset is that
    of the match within the query, in frames.  Candidates share an integer but for one bit, with at most ``_AROUND``
    differing bits in those beside it; each offset at which they do is compared over its whole
    overlap, of ``least_overlap`` frames at least.  An overlap in which no frame comes that
    close is missed.  Rows without a fingerprint or id match nothing.
    """
    prints = prints.select("class_id", "fingerprint").where("class_id IS NOT NULL AND length(fingerprint) > 0")
    kinds = "class_id long, key long, around long, at int"
    keys = prints.mapInArrow(partial(_keys, flipped=False), kinds)
    asked = prints.join(queries.select("class_id").distinct(), "class_id", "left_semi").mapInArrow(partial(_keys, flipped=True), kinds)
    asked = asked.select(F.col("class_id").alias("query_class"), "key", F.col("around").alias("qaround"), F.col("at").alias("qa"))
    alike = F.bit_count(F.col("qaround").bitwiseXOR(F.col("around"))) <= _AROUND
    pairs = asked.join(keys, "key").where((F.col("query_class") != F.col("class_id")) & alike).groupBy("query_class", F.col("class_id").alias("match_class"), (F.col("qa") - F.col("at")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"))
    # at most as many offsets as both have frames
    histograms = pairs.groupBy("query_class", "match_class").agg(F.collect_list("offset").alias("offsets"), F.collect_list("votes").alias("votes"))
    one, two = (prints.select(F.col("class_id").alias(c), F.col("fingerprint").alias(f)) for c, f in (("query_class", "fa"), ("match_class", "fb")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_class", "match_class", "offset", "votes", "overlap", "bit_error"]
        for batch in batches:
            rows = []
            for q, m, o, v, a, b in zip(*(batch.column(c) for c in ("query_class", "match_class", "offsets", "votes", "fa", "fb"))):
                found = best_offset(np.frombuffer(a.as_py(), "<u4"), np.frombuffer(b.as_py(), "<u4"), o.values.to_numpy().astype(np.int64), v.values.to_numpy(), least_overlap)
                if found and found[3] <= most_error:
                    rows.append((q.as_py(), m.as_py(), *found))
            columns = list(zip(*rows)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return histograms.join(one, "query_class").join(two, "match_class").mapInArrow(compare, "query_class long, match_class long, offset int, votes long, overlap int, bit_error double")


def op1_audio_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a recording: its fingerprint's size, hash and class, and for those of conversations whose id is divisible by 20 the best alignment with another class.

    conv_id, turn, n_frames, fingerprint_sha256, class_id, n_copies, is_query, match_class, offset, overlap, bit_error, n_matches.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    prints = saved(fingerprints(turns, "text", ["conv_id", "turn"], melody), "fingerprints")
    classes = saved(prints.groupBy("class_id").agg(F.first("fingerprint").alias("fingerprint"), F.count(F.lit(1)).alias("n_copies"), F.max(F.coalesce(F.col("conv_id") % 20 == 0, F.lit(False))).alias("asked")), "classes")
    found = align(classes, classes.where("asked"))
    best = found.groupBy(F.col("query_class").alias("class_id")).agg(F.count(F.lit(1)).alias("n_matches"), F.min(F.struct("bit_error", (-F.col("overlap")).alias("less"), "match_class", "offset")).alias("b"))
    best = best.select("class_id", "n_matches", F.col("b.match_class").alias("match_class"), F.col("b.offset").alias("offset"), (-F.col("b.less")).alias("overlap"), "b.bit_error")
    rows = prints.select("conv_id", "turn", "n_frames", F.sha2("fingerprint", 256).alias("fingerprint_sha256"), "class_id", F.coalesce(F.col("conv_id") % 20 == 0, F.lit(False)).alias("is_query"))
    rows = rows.join(classes.select("class_id", "n_copies"), "class_id").join(best, "class_id", "left")
    hide = lambda c: F.when(F.col("is_query"), F.col(c)).alias(c)
    return rows.select("conv_id", "turn", "n_frames", "fingerprint_sha256", "class_id", "n_copies", "is_query", hide("match_class"), hide("offset"), hide("overlap"), hide("bit_error"), F.when(F.col("is_query"), F.coalesce("n_matches", F.lit(0))).alias("n_matches"))
