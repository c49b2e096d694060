"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are presence flags of words, word pairs and pairs that skip one
word, hashed to ``2**bits`` slots.  Training follows the per-coordinate FTRL-proximal
rule; its L1 term leaves few weights, which travel to the scoring tasks as two short
arrays (at most 2**bits entries).

Training reads a bounded sample of the labelled rows: of distinct texts with their label,
the ``max_rows`` (12,000) with the least hashes, dealt by hash to ``shards`` tasks that learn
side by side; weights are averaged.  One shard, the default, follows the sequential rule
exactly.  Scoring reads the whole of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import chain, column_bytes, lower_ascii, text_slices, word_hashes, word_spans
from .language_id import held_out

BITS = 20
#: Most training rows.
MAX_ROWS = 12_000
_PAIR, _SKIP = np.uint64(0x51ED270B9F652295), np.uint64(0xD1B54A32D192ED03)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[np.ndarray]:
    """The distinct feature slots of each row."""
    data = lower_ascii(data)
    starts, lengths, bounds = word_spans(data, offsets)
    words = word_hashes(data, starts, lengths)
    shift = np.uint64(64 - bits)
    pairs, skips = chain(words[:-1] ^ _PAIR, words[1:]), chain(words[:-2] ^ _SKIP, words[2:])
    one, two, three = (words >> shift).astype(np.int32), (pairs >> shift).astype(np.int32), (skips >> shift).astype(np.int32)
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield np.unique(np.concatenate([one[a:b], two[a : max(a, b - 1)], three[a : max(a, b - 2)]]))


def train_shard(rows: list[np.ndarray], labels: np.ndarray, bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over one shard; returns the slots with a weight, and the weights.  The last slot is the intercept, without L1."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at = np.append(rows[k], np.int32(1 << bits))
            zs, ns = z[at], n[at]
            limit = np.full(len(at), l1)
            limit[-1] = 0.0
            w = np.where(np.abs(zs) <= limit, 0.0, -(zs - np.sign(zs) * limit) / ((beta + np.sqrt(ns)) / alpha + l2))
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[k]
            grown = np.sqrt(ns + g * g)
            z[at] = zs + g - (grown - np.sqrt(ns)) / alpha * w
            n[at] = ns + g * g
    limit = np.full(len(z), l1)
    limit[-1] = 0.0
    w = np.where(np.abs(z) <= limit, 0.0, -(z - np.sign(z) * limit) / ((beta + np.sqrt(n)) / alpha + l2))
    slots = np.flatnonzero(w)
    return slots, w[slots]


def sample(labelled: DataFrame, max_rows: int, text: str = "text", label: str = "label") -> DataFrame:
    """h, label, text: distinct texts with a 0/1 label, at most ``max_rows`` of them, those with the least hashes."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(3)))
    least = rows.select("h", "label").distinct().orderBy("h", "label").limit(max_rows)
    return rows.join(F.broadcast(least), ["h", "label"]).groupBy("h", "label").agg(F.min("text").alias("text"))


def fit(
    labelled: DataFrame, text: str = "text", label: str = "label", max_rows: int = MAX_ROWS, shards: int = 1, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1e-3, epochs: int = 4
) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) from rows with a text and a 0/1 label; rows with a null in either are passed over.

    Rows with equal texts and labels count once, however often they occur; a text with both
    labels counts for each.  Of more than ``max_rows`` such rows those with the least hashes
    are taken, never more.  Without rows nothing is toxic: all scores are near 0.
    """
    picked = sample(labelled, max_rows, text, label).withColumn("shard", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(shards)).cast("int"))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                data, offsets = column_bytes(part.column("text"))
                slots = [f.astype(np.int32).tobytes() for f in features(data, offsets, bits)]
                yield pa.RecordBatch.from_arrays([part.column("shard"), part.column("h"), part.column("label"), pa.array(slots, pa.binary())], names=["shard", "h", "label", "slots"])

    def shard(table: pa.Table) -> pa.Table:
        # one order of training, whatever order the blocks of a shuffle arrive in
        table = table.sort_by([("h", "ascending"), ("label", "ascending")])
        rows = [np.frombuffer(v.as_buffer(), np.int32) for v in table.column("slots")]
        pa.default_memory_pool().release_unused()
        slots, weights = train_shard(rows, table.column("label").to_numpy(), bits, alpha, beta, l1, l2, epochs)
        return pa.table({"slot": slots, "weight": weights})

    found = picked.select("shard", "h", "label", "text").mapInArrow(featurize, "shard int, h long, label int, slots binary").groupBy("shard").applyInArrow(shard, "slot long, weight double")
    merged = found.groupBy("slot").agg(F.sum("weight").alias("weight")).toPandas()  # at most 2**bits + 1 rows, few after L1
    if merged.empty:
        return np.array([1 << bits]), np.array([-35.0])
    merged = merged.sort_values("slot")
    return merged["slot"].to_numpy(np.int64), (merged["weight"] / shards).to_numpy(np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", keep: list[str] | None = None, threshold: float = 0.3, bits: int = BITS) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (score >= threshold) to the columns in ``keep`` (all by default).

    Null and empty texts get the intercept's score.  Columns of the two names are replaced.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("score", "predicted")]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.int32), model[1].astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((1 << bits) + 1)
        weights[shared.value[0]] = shared.value[1]
        for batch in batches:
            for part in text_slices(batch, "__text"):
                data, offsets = column_bytes(part.column("__text"))
                sums = np.array([weights[f].sum() for f in features(data, offsets, bits)]) + weights[-1]
                p = 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))
                columns = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """text and label of distinct labelled texts that are not held out, the ``max_rows`` with the least hashes.

    Of an id's labels the larger one holds.  Hashes meet the labels first, so only the texts
    that are picked are moved.
    """
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    hashed = docs.where(~held_out() & F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text", F.lit(3)).alias("h"))
    least = hashed.select("doc_id", "h").join(known, "doc_id").select("h", "label").distinct().orderBy("h", "label").limit(max_rows)
    texts = hashed.join(F.broadcast(least.select("h").distinct()), "h").groupBy("h").agg(F.min("text").alias("text"))
    return texts.join(F.broadcast(least), "h").select("text", "label")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(training_rows(docs, labels))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
