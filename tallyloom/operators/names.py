"""Names alike to a threshold, all of one side against all of the other, in blocks.

Names of one batch and one length make up blocks of bounded size, and each two blocks that can
hold similar names are a piece of work of their own.  Within a piece every pair is looked at,
by three bounds, each over the one behind it: letters in common whatever their order (one product
of matrices, a column for each letter and each time that it occurs), the longest common
subsequence (a bit for each letter, many pairs at once), and at last the measure itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import released, saved

#: Names of a side in a block, at most about.
BLOCK = 16_384
#: Columns of the product, letters told apart, rows multiplied at once, pairs of a batch.
COLUMNS, LETTERS, SLAB, PAIRS = 64, 96, 256, 16_384


def least_matched(total: int, threshold: float) -> int:
    """Letters that two names of ``total`` letters together must have in matched blocks."""
    return int(np.ceil(threshold / 2 * total - 1e-9))


def _letters(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the letters of both sides, a row a name; beyond ``LETTERS`` some share a number, which adds to what is in common only."""
    x, y = (np.array(side, dtype=str).view(np.uint32).reshape(len(side), -1) for side in (left, right))
    kinds, number, often = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True, return_counts=True)
    rank = np.empty(len(kinds), np.intp)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(kinds)) % LETTERS
    number = rank[number.ravel()]
    return number[: x.size].reshape(x.shape), number[x.size :].reshape(y.shape)


def _bags(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The product of both is how many letters are in common, or more: what the columns leave out of a row on the left is added to it."""
    counts = []
    for v in (x, y):
        at = np.arange(len(v))[:, None] * LETTERS + v
        counts.append(np.bincount(at.ravel(), minlength=len(v) * LETTERS).reshape(len(v), LETTERS))
    times = [(counts[0] >= n, counts[1] >= n) for n in range(1, int(min(c.max() for c in counts)) + 1)]
    a, b = (np.concatenate([t[k] for t in times], axis=1) for k in (0, 1))
    order = np.argsort(-(a.mean(axis=0) * b.mean(axis=0)), kind="stable")
    kept, rest = order[: COLUMNS - 1], order[COLUMNS - 1 :]
    slack = a[:, rest].sum(axis=1)[:, None]
    left, right = np.hstack([a[:, kept], slack]), np.hstack([b[:, kept], np.ones((len(y), 1), bool)])
    return left.astype(np.float32), np.ascontiguousarray(right.T.astype(np.float32))


def _common(x: np.ndarray, masks: np.ndarray, places: np.ndarray, a: np.ndarray, b: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows a of x and b of the other side those with a common subsequence of ``need`` letters (see ``linkage.common_letters``).

    ``masks`` has the places of each letter in each row of x, ``places`` where the letters of
    the other side have theirs, a row a column.  Half-way pairs go that can't get there.
    """
    kind = masks.dtype.type
    seen, inside = np.full(len(a), ~kind(0)), ~kind(0) >> kind(masks.dtype.itemsize * 8 - x.shape[1])
    check = len(places) * 5 // 8
    for k, column in enumerate(places):
        where = masks.take(column.take(b) + a)
        where &= seen
        seen = (seen + where) | (seen ^ where)
        if k == check or k == len(places) - 1:
            good = np.bitwise_count(~seen & inside) >= need - (len(places) - 1 - k)
            a, b, seen = a[good], b[good], seen[good]
    return a, b


def _masks(x: np.ndarray) -> np.ndarray:
    """A word for each letter and row of x, letter by letter: its places in the row."""
    kind = np.uint32 if x.shape[1] <= 32 else np.uint64
    out = np.zeros(LETTERS * len(x), kind)
    rows = np.arange(len(x))
    for k, column in enumerate(x.T):
        out[column * len(x) + rows] |= kind(1 << k)
    return out


def alike(left: list[str], right: list[str], threshold: float, contained: float, ratio: Callable[[str, str], float]) -> Iterator[tuple[str, str, float]]:
    """(left, right, ratio) of unequal names of two blocks alike to ``threshold``; the names of a block have one length.

    A name inside another counts as ``contained``, whatever the lengths.
    """
    short, long = sorted((len(left[0]), len(right[0])))
    need = least_matched(short + long, threshold)
    inside = short < long and contained >= threshold
    if need >= long and not inside:  # equal names only
        return
    need = min(need, short) if inside else need
    if need > short:
        return
    x, y = _letters(left, right)
    fx, fy = _bags(x, y)
    masks, places = (_masks(x), np.ascontiguousarray(y.T) * len(x)) if x.shape[1] <= 64 else (None, None)
    for top in range(0, len(left), SLAB):
        met = fx[top : top + SLAB] @ fy
        at = np.flatnonzero(met.ravel() > need - 0.5)
        for k in range(0, len(at), PAIRS):
            a, b = np.divmod(at[k : k + PAIRS], len(right))
            a += top
            if masks is not None:
                a, b = _common(x, masks, places, a, b, need)
            for p, q in zip(a.tolist(), b.tolist()):
                if left[p] != right[q] and (sim := ratio(left[p], right[q])) >= threshold:
                    yield left[p], right[q], sim


def _pieces(threshold: float, contained: float, ratio: Callable[[str, str], float]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for batch, left, right in zip(pdf["batch_id"], pdf["left"], pdf["right"]):
                rows: list[tuple] = []
                for found in alike(list(left), list(right), threshold, contained, ratio):
                    rows.append((batch, *found))
                    if len(rows) == 100_000:
                        yield pd.DataFrame(rows, columns=["batch_id", "r_name", "i_name", "sim"])
                        rows = []
                yield pd.DataFrame(rows, columns=["batch_id", "r_name", "i_name", "sim"])

    return run


def similar_in_blocks(left: DataFrame, right: DataFrame, threshold: float, contained: float, ratio: Callable[[str, str], float]) -> DataFrame:
    """batch_id, r_name, i_name, sim of unequal names alike to ``threshold``; left and right have distinct batch_id, name_key."""
    spark = left.sparkSession

    def blocks(names: DataFrame, side: str, to: str) -> DataFrame:
        names = names.withColumn("len", F.length("name_key"))
        sizes = names.groupBy("batch_id", "len").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n"))
        placed = names.join(sizes, ["batch_id", "len"]).withColumn("block", F.pmod(F.xxhash64("name_key"), F.col("n")))
        return saved(placed.groupBy("batch_id", F.col("len").alias(f"{side}_len"), F.col("block").alias(f"{side}_block")).agg(F.collect_list("name_key").alias(to)), "name-blocks")

    r, i = blocks(left, "r", "left"), blocks(right, "i", "right")
    short, total = F.least("r_len", "i_len"), F.col("r_len") + F.col("i_len")
    need = F.ceil(F.lit(threshold / 2) * total - 1e-9)
    inside = (F.col("r_len") != F.col("i_len")) & F.lit(contained >= threshold)
    may = inside | ((need <= short) & (need < F.greatest("r_len", "i_len")))
    # which blocks meet is told by their numbers; the names follow, and pieces are dealt out evenly, a bounded number to a task
    keys = ["batch_id", "r_len", "r_block", "i_len", "i_block"]
    met = saved(r.drop("left").join(i.drop("right"), "batch_id").where(may).select(keys), "name-pieces")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-met.count() // 16))
    whole = met.join(r, keys[:3]).join(i, ["batch_id", *keys[3:]]).repartition(n)
    kind = left.schema["batch_id"].dataType.simpleString()
    found = saved(whole.select("batch_id", "left", "right").mapInPandas(_pieces(threshold, contained, ratio), f"batch_id {kind}, r_name string, i_name string, sim double"), "alike")
    released(met, r, i)
    return found
