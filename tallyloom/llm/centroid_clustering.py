"""Centroid clustering with heap-ordered bounds, on exact integers.

A vector is bound to its cluster by a gap: how much farther its second nearest centroid is
than its own.  Centroids that move by p[j] narrow the gap of a vector of cluster j by
p[j] + max(p of the others) at most, so every cluster keeps one running sum of these
drifts, and a heap of its vectors by gap plus the drift that had been reached when the gap
was measured.  A round pops what lies at or under the cluster's drift, measures these
vectors exactly against all centroids and pushes them into the heaps of their clusters;
nothing else is touched.  A heap is held as an ascending array, in which the expired
vectors are a prefix.

Vectors stand in blocks of a few thousand, as bytes.  They are dealt out once and stay
where they are; a round moves the heaps (12 bytes a vector), the centroids (from the driver)
and, for each task, what vectors that moved take from one sum and add to another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import saved
from .knn_join import matrix, quantized

#: Vectors in a block, and the largest component that distances of 64 components in a long allow.
_BLOCK, _LARGEST = 4096, 1 << 27
_STATE = "block long, sizes array<int>, at binary, gaps binary, change binary, scanned long"


@dataclass
class Clusters:
    """rows: vec_id, cluster, distance of every vector; scanned: vectors measured in each round, and at the end."""

    rows: DataFrame
    centroids: list[list[int]]
    scanned: list[int]


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances, a row a vector."""
    small = float(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))) ** 2 * 4 * max(1, x.shape[1]) < 2**52
    a, c = (v.astype(float) if small else v.astype(np.int64) for v in (x, centroids))
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None]).astype(np.int64)


def measure(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest cluster, gap to the second nearest): ties go to the smaller number; gaps err on the small side."""
    d = distances(x, centroids)
    own, line = d.argmin(axis=1), np.arange(len(d))
    upper = np.sqrt(d[line, own].astype(float))
    if d.shape[1] == 1:
        return own, np.full(len(d), np.inf)
    d[line, own] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(axis=1).astype(float))
    return own, lower - upper - 1e-9 * (1 + lower + upper)


def turn(x: np.ndarray, heaps: list[tuple[np.ndarray, np.ndarray]] | None, centroids: np.ndarray, drift: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, int]:
    """One round of a block: (heaps, what sums and counts change by, vectors measured).

    heaps has (gaps, places) for each cluster, in ascending order of gaps; None before the
    first round, when all vectors are new.
    """
    k, width = centroids.shape
    if heaps is None:
        kept, popped = [(np.zeros(0), np.zeros(0, np.int32))] * k, np.arange(len(x), dtype=np.int32)
        before = np.full(len(x), -1)
    else:
        cuts = [int(np.searchsorted(gaps, drift[j], side="right")) for j, (gaps, _) in enumerate(heaps)]
        popped = np.concatenate([at[:n] for (_, at), n in zip(heaps, cuts)])
        before = np.repeat(np.arange(k), cuts)
        kept = [(gaps[n:], at[n:]) for (gaps, at), n in zip(heaps, cuts)]
    change = np.zeros((k, width + 1), np.int64)
    if not len(popped):
        return kept, change, 0
    own, gap = measure(x[popped], centroids)
    out = []
    for j, (gaps, at) in enumerate(kept):
        mine = np.flatnonzero(own == j)
        if len(mine):
            mine = mine[np.argsort(gap[mine], kind="stable")]
            new = gap[mine] + drift[j]
            where = np.searchsorted(gaps, new, side="right")
            gaps, at = np.insert(gaps, where, new), np.insert(at, where, popped[mine])
        out.append((gaps, at))
        for rows, sign in ((popped[(own == j) & (before != j)], 1), (popped[(before == j) & (own != j)], -1)):
            change[j, :width] += sign * x[rows].astype(np.int64).sum(axis=0)
            change[j, width] += sign * len(rows)
    return out, change, len(popped)


def _packed(width: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = matrix(batch.column("v"), width).astype(np.int64), batch.column("vec_id").to_numpy()
            if len(x) and np.abs(x).max() > _LARGEST:
                raise ValueError(f"components over {_LARGEST} after scaling: squared distances would not fit into a long")
            for at in range(0, len(x), rows):
                columns = [pa.array([v.tobytes()], pa.binary()) for v in (ids[at : at + rows], x[at : at + rows].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "x"])

    return pack


def _heaps(row: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    ends = np.cumsum(row["sizes"])[:-1]
    return list(zip(np.split(np.frombuffer(row["gaps"]), ends), np.split(np.frombuffer(row["at"], np.int32), ends)))


def _advance(centroids: np.ndarray, drift: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                x = np.frombuffer(row["x"], np.int32).reshape(-1, centroids.shape[1])
                heaps, change, scanned = turn(x, _heaps(row) if row.get("sizes") else None, centroids, drift)
                columns = [[row["block"]], [[len(g) for g, _ in heaps]], [np.concatenate([a for _, a in heaps]).astype(np.int32).tobytes()], [np.concatenate([g for g, _ in heaps]).tobytes()], [change.tobytes()], [scanned]]
                kinds = [pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["block", "sizes", "at", "gaps", "change", "scanned"])

    return run


def _changes(state: DataFrame, k: int, width: int) -> tuple[list[list[int]], int]:
    """(what each cluster's sums and count change by, vectors measured): k rows reach the driver, however many blocks there are."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            for change in batch.column("change"):
                total += np.frombuffer(change.as_py(), np.int64).reshape(k, width + 1)
        at, dim = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(dim.astype(np.int32)), pa.array(total[at, dim])], names=["cluster", "dim", "n"])

    out = [[0] * (width + 1) for _ in range(k)]
    summed = state.select("change").mapInArrow(add, "cluster int, dim int, n long").groupBy("cluster", "dim").agg(F.sum("n").alias("n"))
    for r in summed.collect():
        out[r["cluster"]][r["dim"]] = r["n"]
    return out, state.agg(F.sum("scanned")).first()[0] or 0


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors of least sha256 of ``seed:vec_id``; equal ids go by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in vectors.orderBy(order, "v").limit(k).select("v").collect()]


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> Clusters:
    """k-means of vec_id long, v array<long> (see ``quantized``; all of one length), as Lloyd's rule gives it.

    Each round assigns every vector to its nearest centroid (ties: smaller number), then
    replaces every centroid that has vectors by the floor of their mean; at the end vectors
    are assigned once more.  Rows that share an id, or all of a row, count each.  With fewer
    than k vectors there are fewer clusters; without any the result is empty.
    """
    spark = vectors.sparkSession
    now = first_centroids(vectors, k, seed)
    if not now:
        return Clusters(spark.createDataFrame([], "vec_id long, cluster int, distance long"), [], [])
    k, width = len(now), len(now[0])
    blocks = saved(vectors.mapInArrow(_packed(width, _BLOCK), "ids binary, x binary").withColumn("block", F.monotonically_increasing_id()), "vector-blocks")
    # dealt out by block and kept there: a round's heaps come to their vectors
    blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").persist()
    try:
        drift, sums, counts, scanned, state = np.zeros(k), [[0] * width for _ in range(k)], [0] * k, [], None
        for turns in range(rounds + 1):
            centroids = np.array(now, np.int64)
            placed = blocks.select("block", "x") if state is None else blocks.select("block", "x").join(state.select("block", "sizes", "at", "gaps"), "block")
            state = saved(placed.mapInArrow(_advance(centroids, drift), _STATE), "cluster-heaps")
            changed, n = _changes(state, k, width)
            scanned.append(n)
            if turns == rounds:
                break
            for j, row in enumerate(changed):
                sums[j], counts[j] = [a + b for a, b in zip(sums[j], row)], counts[j] + row[width]
            after = [[s // counts[j] for s in sums[j]] if counts[j] else now[j] for j in range(k)]
            if after == now:
                break  # all further rounds are the same
            moved = np.sqrt(((np.array(after, float) - np.array(now, float)) ** 2).sum(axis=1)) * (1 + 1e-12)
            others = [np.delete(moved, j).max(initial=0.0) for j in range(k)]
            drift, now = drift + moved + others, after
        centroids = np.array(now, np.int64)

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in range(batch.num_rows):
                    row = batch.slice(b, 1).to_pylist()[0]
                    x = np.frombuffer(row["x"], np.int32).reshape(-1, width).astype(np.int64)
                    cluster = np.zeros(len(x), np.int32)
                    cluster[np.frombuffer(row["at"], np.int32)] = np.repeat(np.arange(k), row["sizes"])
                    columns = [np.frombuffer(row["ids"], np.int64), cluster, ((x - centroids[cluster]) ** 2).sum(axis=1)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["vec_id", "cluster", "distance"])

        return Clusters(saved(blocks.join(state.select("block", "sizes", "at"), "block").mapInArrow(told, "vec_id long, cluster int, distance long"), "clustered"), now, scanned)
    finally:
        blocks.unpersist()


def with_inertia(found: Clusters) -> DataFrame:
    """The clusters' rows with the distance summed over their cluster and over all, and the hash of their centroid."""
    spark = found.rows.sparkSession
    sums = {r["cluster"]: r["n"] for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # one row a cluster
    rows = [(j, n, sum(sums.values()), hashlib.sha256(",".join(map(str, found.centroids[j])).encode()).hexdigest()) for j, n in sums.items()]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors with exactly 64 finite components (and an id), after ten rounds."""
    vectors = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scale=1024).where(F.size("v") == 64)
    return with_inertia(cluster_vectors(vectors))


def _rounds_sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    own = """CAST(list_dot_product(CAST(g.v AS DOUBLE[]), CAST(g.v AS DOUBLE[])) - 2 * list_dot_product(CAST(g.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) + list_dot_product(CAST(c.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT)"""
    assign = lambda n: f"a{n} AS MATERIALIZED (SELECT line, any_value(vec_id) AS vec_id, any_value(v) AS v, min_by(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT g.*, c.cluster, {own} AS d FROM good g CROSS JOIN c{n} c) GROUP BY line)"
    parts = [
        """good AS MATERIALIZED (SELECT row_number() OVER () AS line, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), v) - 1 AS INTEGER) AS cluster, v FROM good QUALIFY cluster < {k})",
    ]
    for n in range(rounds):
        parts += [
            assign(n),
            f"s{n} AS (SELECT cluster, dim, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM a{n}) GROUP BY ALL)",
            f"m{n} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY dim) AS v FROM s{n} GROUP BY cluster)",
            f"c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m ON c.cluster = m.cluster)",
        ]
    parts.append(assign(rounds))
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"""
    )


OP11_SQL = _rounds_sql()
