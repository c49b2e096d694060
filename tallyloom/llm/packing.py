"""Packing tokenized documents into training sequences by best-fit decreasing.

Tasks tokenize documents and cut each into full windows and one rest.  Only the piece
lengths matter for packing, and there are at most ``window`` different ones, so the
plan is made for the table of counts by length: lengths in falling order, each going
to the tightest open window, which a segment tree over remaining capacities finds.
Equal windows are handled as runs, so the plan's size depends on the window size, not
on the corpus.  A piece finds its place by its length and its rank among equal lengths.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import text_slices
from .word_ids import Ids, WordIds, gathered, numbered, offsets_of
from ..storage import saved

WINDOW = 2048
END_ID = 1
#: Fixed values of the byte-level vocabulary: its split pattern and its special token.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
_MARKS = ",.;:!?"
#: Bytes of text that are worked on at once.
_SLICE = 8 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ids of a byte-level vocabulary file, special tokens left out.

    Such files write a byte that prints as its own character and the others as the
    characters from 256 on, in order."""
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    special = {t["content"] for t in stored["added_tokens"]}
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(prints)]
    byte = {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(hidden)}
    return {bytes(byte[c] for c in token): i for token, i in stored["model"]["vocab"].items() if token not in special}


class Encoder:
    """ids as the tokenizers library gives them, from the distinct words of a slice of texts.

    tiktoken merges the pieces, with the vocabulary of the library's file: it gives the same
    ids in a quarter of the time.  The tests hold whole texts against the tokenizers library.

    A byte-level vocabulary never merges across the pieces of its split pattern, and a
    single blank between two solid characters always starts a new piece.  So a text may be
    cut there.  A run of letters is one piece, and so is a mark that follows it.  Texts where
    a blank has white space on both sides are split by the pattern itself.
    """

    _MIXED = "{0} {0}".format(r"[\s\v\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

    def __init__(self, path: str, most_words: int = 100_000):
        import tiktoken

        ranks = byte_ranks(path)
        self.special = len(ranks)
        self.merge = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={SPECIAL: self.special}).encode_ordinary
        self.split = regex.compile(SPLIT)
        self.marks = {c: self.merge(c) for c in _MARKS}
        # words at the start of a text, and words behind a blank
        self.plain, self.spaced = WordIds(lambda words: self.learn("", words), most_words // 8), WordIds(lambda words: self.learn(" ", words), most_words)

    def tokens(self, text: str) -> list[int]:
        return [i for piece in self.split.findall(text) for i in self.merge(piece)]

    def word(self, prefix: str, word: str) -> list[int]:
        if word.isalpha():
            return self.merge(prefix + word)
        if word and word[-1] in _MARKS and word[:-1].isalpha():
            return self.merge(prefix + word[:-1]) + self.marks[word[-1]]
        return self.tokens(prefix + word)

    def learn(self, prefix: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each) of words behind a prefix."""
        found = [self.word(prefix, w) for w in words]
        return np.fromiter((i for ids in found for i in ids), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def slow(self, text: str) -> list[int]:
        """ids of a text of any kind."""
        return [i for k, t in enumerate(text.split(SPECIAL)) for i in ([self.special] if k else []) + self.tokens(t)]

    def encode(self, texts: pa.Array) -> Ids:
        """(ids one after another, bounds of the texts) of texts without nulls."""
        odd = pc.or_(pc.or_(pc.equal(texts, ""), pc.match_substring(texts, SPECIAL)), pc.match_substring_regex(texts, self._MIXED))
        odd = odd.to_numpy(zero_copy_only=False)
        words, which, bounds = numbered(pc.split_pattern(texts.filter(pa.array(~odd)), " "))
        first = np.zeros(len(which), bool)
        first[bounds[:-1]] = True
        place, flats, offsets, base = np.zeros(len(which), np.int64), [], [np.zeros(1, np.int64)], 0
        for memory, mask in ((self.plain, first), (self.spaced, ~first)):
            counts = np.bincount(which[mask], minlength=len(words))
            used = np.flatnonzero(counts)
            flat, ends = memory.table(words.take(pa.array(used)), counts[used])
            number = np.zeros(len(words), np.int64)
            number[used] = base + np.arange(len(used))
            place[mask] = number[which[mask]]
            flats.append(flat), offsets.append(offsets[-1][-1] + ends[1:])
            base += len(used)
        flat, ends = gathered((np.concatenate(flats), np.concatenate(offsets)), place)
        ends = ends[bounds]
        if not odd.any():
            return flat, ends
        slow = [self.slow(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        order = np.empty(len(texts), np.int64)
        order[~odd], order[odd] = np.arange((~odd).sum()), (~odd).sum() + np.arange(odd.sum())
        both = np.concatenate([flat, np.array([i for ids in slow for i in ids], np.int32)]), np.concatenate([ends, ends[-1] + np.cumsum([len(ids) for ids in slow], dtype=np.int64)])
        return gathered(both, order)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker; what it remembers is a few MB."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, and ids if asked for.

    A document is its ids and the end id; null and empty texts are the end id alone.
    Pieces are full windows from the start and what remains.
    """
    schema = T.StructType([*T._parse_datatype_string(PIECES).fields[1:], *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in text_slices(batch, "text", _SLICE):
                flat, bounds = coder.encode(pc.fill_null(part.column("text"), "").cast(pa.string()))
                flat = np.insert(flat, bounds[1:], end_id).astype("<i4")
                totals = np.diff(bounds) + 1
                pieces = -(-totals // window)
                rows = np.repeat(np.arange(len(totals)), pieces)
                starts = window * (np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                lengths = np.minimum(totals[rows] - starts, window)
                ends = np.cumsum(lengths)  # pieces follow each other without a gap
                raw = memoryview(flat).cast("B")
                crcs = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())), np.int64, len(rows))
                out = [part.column("doc_id").take(pa.array(rows)), *(pa.array(x) for x in (starts, lengths, crcs, totals[rows]))]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(offsets_of(lengths).astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


class _Tightest:
    """Segment tree over remaining capacities: which is the smallest one, of at least a length, with an open window."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.filled = bytearray(2 * self.leaves)

    def put(self, capacity: int, filled: bool) -> None:
        at = capacity + self.leaves
        self.filled[at] = filled
        while at > 1:
            at >>= 1
            self.filled[at] = self.filled[2 * at] | self.filled[2 * at + 1]

    def first(self, least: int) -> int | None:
        at = least + self.leaves
        while not self.filled[at]:
            while at & 1:  # a right child: its parent has nothing further right
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.leaves:
            at *= 2
            at += not self.filled[at]
        return at - self.leaves


def plan(counts: Iterable[tuple[int, int]], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for (length, count) pairs.

    Returns runs (length, first_rank, end_rank, first_sequence, each, offset): the pieces of
    that length with ranks from first_rank on fill ``each`` places of one sequence after
    the other, the first place at ``offset``.
    """
    runs, tree, open_ = [], _Tightest(window), {}
    made = 0

    def keep(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_.setdefault(capacity, []).append((first, n))
            tree.put(capacity, True)

    for length, left in sorted(counts, reverse=True):
        rank = 0
        while left:
            capacity = tree.first(length)
            if capacity is None:
                capacity = window
                first, n = made, -(-left // (window // length))
                made += n
            else:
                first, n = open_[capacity].pop()
                if not open_[capacity]:
                    tree.put(capacity, False)
            each = capacity // length
            whole = min(n, left // each)
            rest = min(left - whole * each, each - 1) if whole < n else 0
            placed = whole * each + rest
            runs.append((length, rank, rank + placed, first, each, window - capacity))
            keep(capacity - each * length, first, whole)
            if rest:
                keep(capacity - rest * length, first + whole, 1)
            keep(capacity, first + whole + bool(rest), n - whole - bool(rest))
            rank, left = rank + placed, left - placed
    return runs


def pack(pieces: DataFrame, window: int = WINDOW, rows_a_bucket: int = 100_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with the columns doc_id, start and length.

    Equal pieces take places of the same length, in any order.  Ranks among equal lengths
    are numbered within hash buckets and shifted by the counts of earlier buckets, so a
    length that a third of all pieces have is no single task's work.
    """
    spark = pieces.sparkSession
    total = pieces.count()
    buckets = max(64, -(-total // rows_a_bucket))
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    groups = dealt.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy("length").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    shifts = groups.select(F.col("length").alias("__l"), F.col("__bucket").alias("__b"), F.coalesce(before, F.lit(0)).alias("__shift"))
    counts = [(r["length"], r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most `window` rows
    runs = spark.createDataFrame(plan(counts, window), "__len long, __from long, __to long, __first long, __each long, __at long")  # bounded by window, see plan
    rank = F.row_number().over(W.partitionBy("length", "__bucket").orderBy("doc_id", "start")) - 1
    ranked = dealt.withColumn("__k", rank).join(shifts, (F.col("length") == F.col("__l")) & (F.col("__bucket") == F.col("__b"))).withColumn("__rank", F.col("__k") + F.col("__shift"))
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("__len")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    nth = F.col("__rank") - F.col("__from")
    return placed.select(
        *pieces.columns,
        (F.col("__first") + F.floor(nth / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__at") + (nth % F.col("__each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Tokenize, cut and pack documents; see ``cut`` and ``pack``."""
    return pack(saved(cut(docs, path or vocabulary_path(), **options), "pieces"), options.get("window", WINDOW))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
