"""Exact top-k search by inner product: a kNN join over a Voronoi partition.

Pivots come from a bounded sample, more of them for more data.  Data and queries fall into
the cells of their nearest pivots, and each cell of data is summed up by its count, radius
and largest norm.  From these summaries alone follows, for every query, a score that its k
best surely reach, and for every cell the most that it can hold for the query.  Only where
the second reaches the first, the query and the cell meet: cells of queries stand together
in large blocks, a slice of data is sent once to each block that has a query for its cell,
and a query only to the slices of the cells that it needs.  The rest is local, and a merge
of the best of each slice.

Scores are exact integers.  The bounds only decide what is sent, and err on the safe side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import saved

#: Vectors and queries that are multiplied at once.
_CHUNK, _QUERIES = 4096, 512


def quantized(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id and v: components floor(scale * x) as longs.

    Left out: null ids, null or empty vectors, vectors that hold a null or a non-finite
    component.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    good = F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False))
    return rows.where(good).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)[None]
    cell = d.argmin(axis=1)
    return cell, np.linalg.norm(x - pivots[cell], axis=1)


def choose_pivots(vectors: DataFrame, total: int, n: int, width: int, sample: int = 4096) -> np.ndarray:
    """n centres (fewer where there are fewer vectors) of a sample of about ``sample`` of the ``total`` vectors, picked by a hash."""
    share = min(1.0, sample / max(total, 1))
    picked = vectors.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1).select("v").distinct().limit(4 * sample).toArrow()
    points = matrix(picked.column("v"), width).astype(float) if picked.num_rows else np.zeros((1, width))
    points = np.unique(points, axis=0)
    centres = points[np.random.default_rng(5).permutation(len(points))[:n]]
    for _ in range(4):
        cell = _nearest(points, centres)[0]
        centres = np.array([points[cell == k].mean(axis=0) if (cell == k).any() else centres[k] for k in range(len(centres))])
    return centres


def reach(q: np.ndarray, pivots: np.ndarray, count: np.ndarray, radius: np.ndarray, norm: np.ndarray, k: int) -> np.ndarray:
    """Which queries (rows) have to meet which cells of data (columns), as booleans.

    With x in a cell around p, q x lies within |q| radius of q p, and is at most |q| norm.
    From the cells of surest scores on, as soon as k others than the query are counted, the
    query's k best surely reach that cell's surest score.
    """
    if not len(q):
        return np.zeros((0, len(pivots)), bool)
    middle, length = q @ pivots.T, np.linalg.norm(q, axis=1)[:, None]
    sure, most = middle - length * radius, np.minimum(middle + length * radius, length * norm)
    order = np.argsort(-sure, axis=1, kind="stable")
    have = np.cumsum(count[order], axis=1) >= k + 1  # the query itself may be one of them
    at = order[np.arange(len(q)), have.argmax(axis=1)]
    least = np.where(have[:, -1], sure[np.arange(len(q)), at], -np.inf)[:, None]
    slack = 1e-9 * (1 + length * (np.abs(norm) + np.linalg.norm(pivots, axis=1) + radius))
    return (most + slack >= least - slack) & (count > 0)


def deal_blocks(pivots: np.ndarray, counts: dict[int, int], block: int) -> dict[int, tuple[int, int]]:
    """(first block, number of blocks) of each cell of queries: small cells share a block with near ones, large ones have several."""
    out, used, now = {}, 0, 0
    left = sorted(counts)
    at = left[0] if left else None
    while left:
        left.remove(at)
        n = counts[at]
        if n > block:
            parts = -(-n // block)
            out[at] = (used + (1 if now else 0), parts)
            used, now = out[at][0] + parts, 0
        else:
            if now + n > block:
                used, now = used + 1, 0
            out[at], now = (used, 1), now + n
        if left:
            at = min(left, key=lambda c: float(((pivots[c] - pivots[at]) ** 2).sum()))
    return out


def best(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the k best of x for each query; ties go to smaller ids, and x with the query's id is left out."""
    order = np.argsort(x_ids, kind="stable")
    x_ids, x = x_ids[order], x[order]
    small = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**40
    qf = q.astype(float) if small else q
    rows, ids, scores = [], [], []
    for at in range(0, len(x), _CHUNK):
        part, part_ids = x[at : at + _CHUNK], x_ids[at : at + _CHUNK]
        s = (qf @ part.astype(float).T).astype(np.int64) if small else q @ part.T
        own = q_ids[:, None] == part_ids[None, :]
        if small:
            # score and place in one key: no two are equal
            key = s * _CHUNK + (_CHUNK - 1 - np.arange(len(part)))
            key[own] = np.iinfo(np.int64).min
            n = min(k, len(part))
            top = np.argpartition(key, len(part) - n, axis=1)[:, len(part) - n :]
        else:
            top = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
        line = np.repeat(np.arange(len(q)), top.shape[1])
        flat = top.ravel()
        fine = ~own[line, flat]
        rows.append(line[fine]), ids.append(part_ids[flat[fine]]), scores.append(s[line[fine], flat[fine]])
    rows, ids, scores = (np.concatenate(v) for v in (rows, ids, scores))
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], ids[rank < k], scores[rank < k]


def knn_join(queries: DataFrame, data: DataFrame, k: int = 20, pivots: int | None = None, block: int = 16_384, slice_rows: int = 32_768) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with the data, ties to smaller ids.

    Both tables have vec_id long and v array<long> (see ``quantized``); shorter vectors count
    as ending in zeros.  Data with the query's id is the query itself and left out.  Equal
    query rows are answered once; rows that share an id but not the vector are answered each.
    Equal rows of data are ranked each.  pivots: by default one for 4,096 rows, 16 to 256.
    """
    spark = data.sparkSession
    sizes = data.agg(F.max(F.size("v")).alias("w"), F.count(F.lit(1)).alias("n")).first()
    width = max(1, sizes["w"] or 1, queries.agg(F.max(F.size("v"))).first()[0] or 1)
    centres = choose_pivots(data, sizes["n"], pivots or min(256, max(16, sizes["n"] // 4096)), width)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), width).astype(float)
            cell, far = _nearest(x, centres) if len(x) else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(far), pa.array(np.linalg.norm(x, axis=1))], names=["cell", "far", "norm"])

    held = data.select("v").mapInArrow(cells, "cell int, far double, norm double").groupBy("cell")
    count, radius, norm = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros(len(centres))
    for r in held.agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect():  # one row a pivot
        count[r["cell"]], radius[r["cell"]], norm[r["cell"]] = r["n"], r["far"], r["norm"]
    slices = np.maximum(1, -(-count // slice_rows))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), width).astype(float)
            own = _nearest(x, centres)[0] if len(x) else np.zeros(0, int)
            needed = reach(x, centres, count, radius, norm, k)
            where = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], needed.sum(axis=1).cumsum()]).astype(np.int32)), pa.array(np.nonzero(needed)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(own.astype(np.int32)), where], names=["vec_id", "v", "own", "needed"])

    asked = saved(queries.select("vec_id", "v").distinct().mapInArrow(ask, "vec_id long, v array<long>, own int, needed array<int>"), "queries")
    blocks = deal_blocks(centres, {r["own"]: r["n"] for r in asked.groupBy("own").agg(F.count(F.lit(1)).alias("n")).collect()}, block)
    met = asked.select("own", F.explode("needed").alias("cell")).distinct().collect()  # at most the square of the pivots
    deal = sorted({(r["cell"], b) for r in met for b in range(blocks[r["own"]][0], sum(blocks[r["own"]]))})

    odd = np.random.default_rng(11).integers(0, 1 << 63, width + 1).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors by cell and slice; of equal rows in a batch no more than can be among the k best."""
        for batch in batches:
            whole, ids = matrix(batch.column("v"), width).astype(np.int64), batch.column("vec_id").to_numpy()
            if not len(ids):
                continue
            cell = _nearest(whole.astype(float), centres)[0]
            mixed = (ids.astype(np.uint64) * odd[0] + whole.astype(np.uint64) @ odd[1:]) >> np.uint64(33)
            part = (mixed % slices[cell].astype(np.uint64)).astype(np.int64)
            if len(np.unique(ids)) < len(ids):
                order = np.lexsort((*whole.T, ids))
                fresh = np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (whole[order][1:] != whole[order][:-1]).any(axis=1)])
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))
                kept = np.sort(order[np.arange(len(ids)) - first < k])
                whole, ids, cell, part = whole[kept], ids[kept], cell[kept], part[kept]
            order = np.lexsort((part, cell))
            cuts = np.flatnonzero(np.diff(cell[order]) | np.diff(part[order])) + 1
            groups = np.split(order, cuts)
            columns = [pa.array([int(v[g[0]]) for g in groups], pa.int32()) for v in (cell, part)]
            columns += [pa.array([v[g].tobytes() for g in groups], pa.binary()) for v in (ids, whole)]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "slice", "ids", "rows"])

    sent = data.select("vec_id", "v").mapInArrow(packs, "cell int, slice int, ids binary, rows binary").join(spark.createDataFrame(deal, "cell int, block int"), "cell")
    first_and_n = spark.createDataFrame([(c, *b) for c, b in blocks.items()], "own int, first int, n int")
    n_slices = spark.createDataFrame([(c, int(n)) for c, n in enumerate(slices)], "cell int, slices int")
    wanted = asked.join(first_and_n, "own").withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("n")).cast("int"))
    wanted = wanted.select("block", "vec_id", F.xxhash64("v").alias("qkey"), "v", F.explode("needed").alias("cell")).join(n_slices, "cell")
    wanted = wanted.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            rows, ids, scores = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64)
            q_ids = q_keys = np.zeros(0, np.int64)
        else:
            q_ids, q_keys = left.column("vec_id").to_numpy(), left.column("qkey").to_numpy()
            x_ids = np.frombuffer(b"".join(right.column("ids").to_pylist()), np.int64)
            x = np.frombuffer(b"".join(right.column("rows").to_pylist()), np.int64).reshape(-1, width)
            q = matrix(left.column("v"), width)
            some = [best(q_ids[at : at + _QUERIES], q[at : at + _QUERIES], x_ids, x, k) for at in range(0, len(q), _QUERIES)]
            rows = np.concatenate([r + at * _QUERIES for at, (r, _, _) in enumerate(some)])
            ids, scores = (np.concatenate(c) for c in list(zip(*some))[1:])
        return pa.table({"query_id": q_ids[rows], "qkey": q_keys[rows], "vec_id": ids, "score": scores})

    keys = ("block", "cell", "slice")
    found = wanted.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(solve, "query_id long, qkey long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every vector whose id is divisible by 20 with all others."""
    vectors = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return knn_join(vectors.where(F.col("vec_id") % 20 == 0), vectors)


OP5_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM good q JOIN good d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""
