"""Hard negatives by Four-Russians scoring.

Components are integers of a few bits.  A candidate is kept as bit planes: for every bit of
its components (two's complement) and every group of eight dimensions, one byte says in
which of the eight that bit is set.  An anchor has a table for each group with the sums of
all 256 subsets of its eight components.  The inner product of the two is then a look-up of
each byte in its group's table, added up plane by plane from the highest bit on, where the
sum so far is doubled before each plane and the sign's plane counts negative: additions
only, and exact.

Anchors are dealt out in blocks and candidates in slices, and each block meets each slice
once for positives and once for negatives, whatever labels or vectors are frequent.  Only
the best few of a slice leave its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import saved
from .knn_join import matrix

#: Anchors in a block and looked up at once; candidates in a slice and looked up at once.
_BLOCK, _ANCHORS, _SLICE, _ROWS = 4096, 256, 8192, 1024


def labelled(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """vec_id, label, v: components floor(scale * x) as longs.

    Left out: null ids, labels or vectors, and vectors that hold a null or a non-finite component.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    good = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))
    return rows.where(good).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def bit_planes(x: np.ndarray, bits: int) -> np.ndarray:
    """Bytes by plane, group of eight columns, and row; columns are filled up with zeros."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % 8)))
    return np.stack([np.packbits((x >> b) & 1 != 0, axis=1, bitorder="little").T for b in range(bits)])


def subset_sums(a: np.ndarray, kind: type) -> np.ndarray:
    """Sums by group of eight columns, subset and row of a: every subset's is a smaller one's and one component more."""
    a = np.pad(a, ((0, 0), (0, -a.shape[1] % 8))).astype(kind)
    out = np.zeros((a.shape[1] // 8, 256, len(a)), kind)
    for g, table in enumerate(out):
        for k in range(8):
            table[1 << k : 2 << k] = table[: 1 << k] + a[:, 8 * g + k]
    return out


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Inner products of candidates (rows) and anchors (columns), from bit planes and subset sums."""
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    found = np.empty_like(total)
    for b in range(len(planes) - 1, -1, -1):
        total += total
        add = np.subtract if b == len(planes) - 1 else np.add
        for group, table in zip(planes[b], tables):
            np.take(table, group, axis=0, out=found, mode="clip")
            add(total, found, out=total)
    return total


def _first(anchor: np.ndarray, ids: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of each anchor, by falling score, then id."""
    order = np.lexsort((ids, -score.astype(np.int64), anchor))
    line = anchor[order]
    return order[np.arange(len(order)) - np.searchsorted(line, line) < n]


def _shape(data: DataFrame) -> tuple[int, int, type]:
    """(dimensions, bits of a component with its sign, integer type that scores fit in)."""
    top = data.agg(F.max(F.size("v")).alias("w"), F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))).alias("m")).first()
    width, most = max(1, top["w"] or 1), top["m"] or 0
    if width * most * most >= 1 << 62:
        raise ValueError("components so large that scores would not fit into a long")
    return width, most.bit_length() + 1, np.int32 if width * (most + 1) ** 2 < 1 << 30 else np.int64


def _slices(data: DataFrame, width: int, bits: int) -> DataFrame:
    """Candidates as rows of up to a slice's number: slice, ids, labels, planes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids, labels = matrix(batch.column("v"), width), batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            for at in range(0, len(x), _SLICE):
                to = at + _SLICE
                columns = [ids[at:to].tobytes(), labels[at:to].tobytes(), bit_planes(x[at:to], bits).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["ids", "labels", "planes"])

    return saved(data.mapInArrow(pack, "ids binary, labels binary, planes binary").withColumn("slice", F.monotonically_increasing_id()), "negative-slices")


def _blocks(anchors: DataFrame, width: int) -> DataFrame:
    """Anchors as rows of up to a block's number: block, and their columns as bytes; positives has their scores, best first."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                columns = [part.column(c).to_numpy().tobytes() for c in ("anchor", "vec_id", "label")] + [matrix(part.column("v"), width).astype(np.int64).tobytes()]
                lists = part.column("positives")
                n = np.diff(lists.offsets.to_numpy())
                columns += [n.astype(np.int64).tobytes(), matrix(lists, int(n.max(initial=0))).astype(np.int64).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["anchor", "vec_id", "label", "v", "n", "positives"])

    return saved(anchors.mapInArrow(pack, "anchor binary, vec_id binary, label binary, v binary, n binary, positives binary").withColumn("block", F.monotonically_increasing_id()), "anchor-blocks")


def _meet(blocks: DataFrame, slices: DataFrame, solve: Callable[[dict, dict], list[np.ndarray]], names: list[str]) -> DataFrame:
    """What ``solve`` finds for each block and slice; a task has one of each at a time."""
    spark = blocks.sparkSession
    numbers = {}
    for kind, rows in (("block", blocks), ("slice", slices)):
        ids = sorted(r[0] for r in rows.select(kind).collect())  # one number for 4,096 anchors, one for 8,192 candidates
        numbers[kind] = (F.broadcast(spark.createDataFrame(list(zip(ids, range(len(ids)))), f"{kind} long, {kind}_no int")), len(ids))
    dealt = lambda rows, kind, other: rows.join(numbers[kind][0], kind).drop(kind).withColumn(f"{other}_no", F.explode(F.sequence(F.lit(0), F.lit(max(numbers[other][1] - 1, 0)))))
    keys = ("block_no", "slice_no")

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [solve(a, x) for a in left.to_pylist() for x in right.to_pylist()]
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(names)
        return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(names, columns)})

    return dealt(blocks, "block", "slice").groupBy(*keys).cogroup(dealt(slices, "slice", "block").groupBy(*keys)).applyInArrow(each, ", ".join(f"{n} long" for n in names))


def _opened(block: dict, piece: dict, width: int, bits: int) -> tuple:
    anchor, vec_id, label = (np.frombuffer(block[c], np.int64) for c in ("anchor", "vec_id", "label"))
    a, positives = np.frombuffer(block["v"], np.int64).reshape(len(anchor), width), np.frombuffer(block["positives"], np.int64).reshape(len(anchor), -1)
    ids, labels = (np.frombuffer(piece[c], np.int64) for c in ("ids", "labels"))
    return anchor, vec_id, label, a, positives, ids, labels, np.frombuffer(piece["planes"], np.uint8).reshape(bits, -(-width // 8), len(ids))


def hard_negatives(anchors: DataFrame, data: DataFrame, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Both tables have vec_id, label and v (see ``labelled``); shorter vectors count as ending
    in zeros.  Of rows with another id, an anchor's positives are the first ``n_positives``
    of its label by falling inner product (ties: smaller id), and for each of them its
    negatives are the first ``n_negatives`` of other labels whose score is ``low`` to ``high``
    percent of the positive's: none where that is negative.  Equal anchor rows are answered
    once, rows that share an id only are answered each; equal candidates count each.
    """
    width, bits, kind = _shape(anchors.select("v").unionByName(data.select("v")))
    anchors = saved(anchors.select("vec_id", "label", "v").distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    slices = _slices(data, width, bits)
    none = F.array().cast("array<long>").alias("positives")

    def alike(block: dict, piece: dict) -> list[np.ndarray]:
        anchor, vec_id, label, a, _, ids, labels, planes = _opened(block, piece, width, bits)
        out = [[np.zeros(0, np.int64)] * 4]
        for own in np.intersect1d(label, labels):
            mine, theirs = np.flatnonzero(label == own), np.flatnonzero(labels == own)
            for at in range(0, len(mine), _ANCHORS):
                some = mine[at : at + _ANCHORS]
                tables = subset_sums(a[some], kind)
                for k in range(0, len(theirs), _ROWS):
                    part = theirs[k : k + _ROWS]
                    s = scores(np.ascontiguousarray(planes[:, :, part]), tables)
                    n = min(n_positives, len(part))
                    # ties at the border of the best are all kept until ids decide
                    border = np.partition(np.where(ids[part][:, None] == vec_id[some], np.iinfo(kind).min, s), len(part) - n, axis=0)[len(part) - n]
                    row, col = np.nonzero((s >= border) & (ids[part][:, None] != vec_id[some]))
                    best = _first(col, ids[part[row]], s[row, col], n_positives)
                    row, col = row[best], col[best]
                    out.append([anchor[some[col]], vec_id[some[col]], ids[part[row]], s[row, col]])
        return [np.concatenate(c) for c in zip(*out)]

    found = _meet(_blocks(anchors.withColumn("positives", none), width), slices, alike, ["anchor", "anchor_id", "positive_id", "score"])
    nth = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "positive_id"))
    best = saved(found.withColumn("p", nth).where(F.col("p") <= n_positives), "positives")
    listed = best.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "score"))), lambda x: x["score"]).alias("positives"))

    def unlike(block: dict, piece: dict) -> list[np.ndarray]:
        anchor, _, label, a, positives, ids, labels, planes = _opened(block, piece, width, bits)
        has = np.arange(positives.shape[1]) < np.frombuffer(block["n"], np.int64)[:, None]  # other places are filled up
        least, most = -((-low * positives) // 100), (high * positives) // 100
        least, most = np.where(has, least, np.iinfo(np.int64).max), np.where(has, most, np.iinfo(np.int64).min)
        out = [[np.zeros(0, np.int64)] * 4]
        for at in range(0, len(a), _ANCHORS):
            some = slice(at, at + _ANCHORS)
            tables, lo, hi = subset_sums(a[some], kind), least[some], most[some]
            for k in range(0, len(ids), _ROWS):
                part = slice(k, k + _ROWS)
                s = scores(np.ascontiguousarray(planes[:, :, part]), tables)
                row, col = np.nonzero((s >= lo.min(axis=1)) & (s <= hi.max(axis=1)) & (labels[part][:, None] != label[some]))
                order = np.lexsort((ids[part][row], -s[row, col].astype(np.int64), col))
                row, col = row[order], col[order]
                value = s[row, col].astype(np.int64)
                for p in range(lo.shape[1]):
                    fits = np.flatnonzero((value >= lo[col, p]) & (value <= hi[col, p]))
                    line = col[fits]
                    fits = fits[np.arange(len(fits)) - np.searchsorted(line, line) < n_negatives]
                    out.append([anchor[some][col[fits]], np.full(len(fits), p + 1), ids[part][row[fits]], value[fits]])
        return [np.concatenate(c) for c in zip(*out)]

    asked = anchors.join(listed, "anchor")
    found = _meet(_blocks(asked.select("anchor", "vec_id", "label", "v", "positives"), width), slices, unlike, ["anchor", "p", "negative_id", "negative_score"])
    rank = F.row_number().over(W.partitionBy("anchor", "p").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= n_negatives)
    return best.withColumn("p", F.col("p").cast("long")).join(ranked, ["anchor", "p"]).select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of 50 to 95 percent of a positive's score for every vector whose id is divisible by 50; every seventh label is wrong."""
    rows = labelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows.where(F.col("vec_id") % 50 == 0), rows)


OP13_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), anchors AS (SELECT DISTINCT vec_id, label, v FROM good WHERE vec_id % 50 = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, a.v AS anchor, d.vec_id, d.label = a.label AS alike, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM anchors a JOIN good d ON a.vec_id <> d.vec_id
), positives AS (
  SELECT anchor_id, anchor_label, anchor, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id, anchor_label, anchor ORDER BY score DESC, vec_id) AS p FROM scored WHERE alike QUALIFY p <= 5
), ranked AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.anchor_label, p.anchor, p.p ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND p.anchor_label = s.anchor_label AND p.anchor = s.anchor AND NOT s.alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
