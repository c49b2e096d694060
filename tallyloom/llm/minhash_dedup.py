"""Near-duplicate documents by MinHash with sequential Bayesian verification.

1. Tasks turn each text into its set of word shingles, as 64-bit hashes, and a signature
   of ``BANDS * ROWS`` MinHash values.  Texts whose sets agree in two 64-bit sums over all
   shingles become one class, which is numbered when the table of classes is written.
2. Classes that agree in a band are candidates.  In each bucket all are first compared with
   one class only, the one that meets most others in all of its buckets; that joins groups
   of copies without listing their pairs.  Members of buckets that still hold several components are
   then searched once more, pairs of different components only, by their rarest shingles.
3. A candidate pair is judged on its signatures, batch by batch: it goes as soon as the
   posterior probability of a similarity at the threshold is under ``miss``.  Survivors are
   verified exactly on their full sets.
4. Components of the confirmed links give each document its group.

At the threshold of 0.85 a pair fails to meet in any band with a probability of 2e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import chain, column_bytes, lower_ascii, mix64, text_slices, word_hashes, word_spans
from ..operators.components import components
from ..storage import saved

BANDS, ROWS, BATCH = 24, 4, 16
_LEAD = np.uint64(0xA0761D6478BD642F)
_SECOND = np.uint64(0xE7037ED1A0B428DB)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 3) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of ``width`` words in a row, for each text; of a text with fewer words, one for all of it."""
    data = lower_ascii(data)
    starts, lengths, bounds = word_spans(data, offsets)
    grams = [word_hashes(data, starts, lengths)]  # of one word, two words, ...
    for k in range(1, width):
        before = grams[-1][:-1]
        grams.append(chain(before ^ _LEAD if k == 1 else before, grams[0][k:]))
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            yield np.unique(grams[-1][a : b - width + 1])
        else:
            yield grams[max(b - a, 1) - 1][a : a + (b > a)]


def set_sums(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums over a set of shingles, mixed in different ways: 128 bits that stand for the set."""
    once = mix64(shingles)
    return int(once.sum(dtype=np.uint64)), int(mix64(once ^ _SECOND).sum(dtype=np.uint64))


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall to each of 256 places, modulo 2, as four longs: sets that differ in d shingles differ in d bits at most."""
    odd = np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(20)
    return rnd.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32), rnd.integers(0, 1 << 31, n, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray], step: int = 2048) -> np.ndarray:
    """The least value of each hash function over a set, all functions at once for ``step`` shingles at a time."""
    low = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    flip, factor = family[0][:, None], family[1][:, None]
    out = np.full(len(family[0]), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), step):
        values = low[None, at : at + step] ^ flip
        values *= factor
        values ^= high[at : at + step]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest matches of n with which P(similarity >= threshold | matches) is at least ``miss``, under a uniform prior.

    That posterior is the probability of at most m successes in n + 1 trials at the threshold."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def survivors(left: np.ndarray, right: np.ndarray, threshold: float, miss: float, batch: int = BATCH) -> np.ndarray:
    """Indices of the signature pairs (rows of left and right) that no batch prunes."""
    live = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for to in range(batch, left.shape[1] + 1, batch):
        matches = matches + (left[live, to - batch : to] == right[live, to - batch : to]).sum(axis=1)
        good = matches >= least_matches(to, threshold, miss)
        live, matches = live[good], matches[good]
    return live


def _sets(width: int, with_signature: bool):
    """Rows of (passed columns, n, h1, h2, signature, bits) or (passed columns, shingles)."""
    family = _family(BANDS * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                data, offsets = column_bytes(part.column("text"))
                passed = [part.column(i) for i, c in enumerate(part.schema.names) if c != "text"]
                names = [c for c in part.schema.names if c != "text"]
                found = list(shingle_sets(data, offsets, width))
                if not with_signature:
                    yield pa.RecordBatch.from_arrays([*passed, pa.array([s.tobytes() for s in found], pa.binary())], names=[*names, "shingles"])
                    continue
                sizes = np.array([len(s) for s in found], np.int64)
                ids = np.array([set_sums(s) for s in found], np.uint64).reshape(-1, 2).view(np.int64)
                signs = [signature(s, family).tobytes() if len(s) else None for s in found]
                bits = np.array([parity_bits(s) for s in found]).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([*passed, pa.array(sizes), *(pa.array(np.ascontiguousarray(ids[:, k])) for k in range(2)), pa.array(signs, pa.binary()), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4))], names=[*names, "n", "h1", "h2", "signature", "b0", "b1", "b2", "b3"])

    return run


def _prune(threshold: float, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(column_bytes(batch.column(c))[0].tobytes(), np.uint32).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            keep = pa.array(survivors(left, right, threshold, miss))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("xa"), batch.column("xb"))):
                one, two = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * both >= percent * (len(one) + len(two) - both):
                    keep.append(k)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    return run


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a set: set_id, root, n, shingle."""
    for batch in batches:
        for k in range(batch.num_rows):
            items = np.frombuffer(batch.column("shingles")[k].as_py(), np.int64)
            same = [pa.array(np.full(len(items), batch.column(c)[k].as_py())) for c in ("set_id", "root")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(len(items), len(items))), pa.array(items)], names=["set_id", "root", "n", "shingle"])


def _prefix_pairs(sets: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets in different components that may be linked; no linked pair is missing.

    sets has set_id, root and shingles; bits has set_id and ``parity_bits`` as b0 to b3.
    Linked sets of n and m shingles share c = ceil(percent * (n + m) / (100 + percent)) at
    least, so each has a shared one among its n - c + 1 (m - c + 1) rarest: the larger set is
    looked up by the longest such prefix, the smaller one by that for partners no smaller.
    They differ in n + m - 2 * c shingles at most, so in as many parity bits.  Texts that
    share a passage, however many, differ in more.
    """
    rows = saved(sets.mapInArrow(_shingle_rows, "set_id long, root long, n long, shingle long"), "shingles")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), (F.min("root") < F.max("root")).alias("apart"))
    nth = F.row_number().over(W.partitionBy("set_id").orderBy("df", "shingle"))
    ranked = rows.join(often, "shingle").withColumn("nth", nth)
    up = lambda x, by: F.floor((x + (by - 1)) / by)
    prefix = ranked.where((F.col("nth") <= F.col("n") - up(F.col("n") * percent, 100) + 1) & F.col("apart")).select("shingle", "set_id", "root", "n", "nth")
    prefix = saved(prefix.join(bits, "set_id"), "prefixes")
    short = prefix.where(F.col("nth") <= F.col("n") - up(2 * percent * F.col("n"), 100 + percent) + 1)
    other = short.select("shingle", F.col("set_id").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("nth").alias("nthb"), *(F.col(f"b{k}").alias(f"c{k}") for k in range(4)))
    both = F.col("n") + F.col("nb")
    common = up(percent * both, 100 + percent)
    larger = (F.col("n") > F.col("nb")) | ((F.col("n") == F.col("nb")) & (F.col("set_id") > F.col("b")))
    placed = (F.col("nth") <= F.col("n") - common + 1) & (F.col("nthb") <= F.col("nb") - common + 1)
    differ = sum((F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"c{k}"))) for k in range(4)), F.lit(0))
    met = prefix.join(other, "shingle").where(larger & (F.col("root") != F.col("rb")) & placed & (differ <= both - 2 * common))
    return met.select(F.col("set_id").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 85, miss: float = 1e-6, width: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Two texts are linked where 100 * intersection >= percent * union of their sets of
    ``width`` words in a row.
    component_id is the smallest id of the group; kept says that it is the row's own.  Texts
    that are null or hold no word have no shingles and no links.  Rows with a null id take
    the smallest id of their group, or null; rows that share an id and a group are kept or
    dropped alike.
    """
    threshold = percent / 100
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"))
    kind = source.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("th", T.LongType())]
    sets = saved(source.mapInArrow(_sets(width, True), T.StructType([*fields, *T._parse_datatype_string("n long, h1 long, h2 long, signature binary, b0 long, b1 long, b2 long, b3 long").fields])), "sets")
    solid = sets.where("n > 0")
    classes = solid.groupBy("n", "h1", "h2").agg(F.min(F.struct("doc_id", "th")).alias("one"), F.first("signature").alias("signature"), *(F.first(f"b{k}").alias(f"b{k}") for k in range(4)), F.min("doc_id").alias("least"))
    classes = saved(classes.withColumn("set_id", F.monotonically_increasing_id()), "classes")

    def full_sets(wanted: DataFrame, name: str) -> DataFrame:
        """wanted with the shingle set of each set_id, made again from one text of the class."""
        need = classes.join(wanted, "set_id").select(*wanted.columns, "one.doc_id", "one.th")
        held = source.join(need, [source["th"] == need["th"], source["doc_id"].eqNullSafe(need["doc_id"])]).select(*(need[c] for c in wanted.columns), source["text"])
        kinds = T.StructType([*(wanted.schema[c] for c in wanted.columns), T.StructField("shingles", T.BinaryType())])
        return saved(held.mapInArrow(_sets(width, False), kinds).dropDuplicates(["set_id"]), name)

    def confirmed(pairs: DataFrame, full: DataFrame, name: str) -> DataFrame:
        """The pairs that hold on full sets."""
        one, two = (full.select(F.col("set_id").alias(s), F.col("shingles").alias(f"x{s}")) for s in "ab")
        return saved(pairs.join(one, "a").join(two, "b").mapInArrow(_confirm(percent), "a long, b long"), name)

    slices = F.array(*(F.xxhash64(F.lit(i), F.substring("signature", 1 + 4 * ROWS * i, 4 * ROWS)) for i in range(BANDS)))
    bands = classes.select("set_id", F.explode(slices).alias("band"))
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    bands = saved(bands.join(sizes, "band"), "bands")
    # the member of a bucket that meets most others in all of its buckets stands in the middle of a group of noisy copies
    met = bands.groupBy("set_id").agg(F.sum("m").alias("met"))
    pivots = bands.join(met, "set_id").groupBy("band").agg(F.max(F.struct("met", "set_id")).alias("p")).select("band", F.col("p.set_id").alias("a"))
    stars = bands.join(pivots, "band").where("set_id <> a").select("a", F.col("set_id").alias("b")).distinct()
    signs = classes.select("set_id", "signature")
    one, two = (signs.select(F.col("set_id").alias(s), F.col("signature").alias(f"s{s}")) for s in "ab")
    prune = lambda pairs: pairs.join(one, "a").join(two, "b").mapInArrow(_prune(threshold, miss), "a long, b long")
    tested = saved(prune(stars), "stars")
    ends = tested.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    links = confirmed(tested, full_sets(ends, "star-sets"), "star-links")
    roots = saved(components(links), "roots")

    # members of buckets in which several components remain
    near = bands.join(roots, F.col("set_id") == F.col("node"), "left").select("band", "set_id", F.coalesce("root", "set_id").alias("root"))
    near = saved(near, "members")
    apart = near.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    rest = full_sets(near.join(apart, "band", "left_semi").select("set_id", "root").distinct(), "rest-sets")
    more = confirmed(prune(_prefix_pairs(rest, classes.select("set_id", "b0", "b1", "b2", "b3"), percent)), rest, "rest-links")
    again = more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    top = components(again.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    top = top.select(F.col("node").alias("root"), F.col("root").alias("top"))

    grouped = classes.select("set_id", "n", "h1", "h2", "least").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    grouped = saved(grouped.join(top, "root", "left").select("n", "h1", "h2", "least", F.coalesce("top", "root").alias("group")), "groups")
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    ids = grouped.join(least, "group").select("n", "h1", "h2", "component_id")
    out = solid.select("doc_id", "n", "h1", "h2").join(ids, ["n", "h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = out.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    found = near_duplicates(docs, text, doc_id, **options).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(found, F.col(doc_id).eqNullSafe(F.col("__kept")), "left_semi")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows in SQL: sets, all pairs that share a shingle, links, and what can be reached.
OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least l USING (doc_id)
"""
