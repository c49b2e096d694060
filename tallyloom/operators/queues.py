"""First come, first served, between groups of requests and queues of invoices.

In turn, each request takes the invoice with the smallest number among the first ones that
are left in the queues of its group.  A part (requests and invoices that can meet) may
be of any size: its requests are cut into turns of a bounded number, which run side by
side.  What a turn needs to know of the earlier ones is how many invoices each queue has given
away.  That is guessed first (as if every request could take from every queue), each turn
counts what it takes, and turns run again until the sums of what earlier turns take are what
was assumed.  The first turn is right at once and each round makes one more right at least,
whatever the guess; the result is that of one long walk.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import saved
from .ranks import ranked

#: Requests in a turn.
TURN = 20_000


def walk(requests: list[tuple[int, int]], queues: dict[int, list[int]], allowed: dict[int, list[int]]) -> list[tuple[int, int, int]]:
    """(request, invoice, queue) of requests (number, group) in order; queues are in ascending order."""
    heads, out = dict.fromkeys(queues, 0), []
    for at, group in sorted(requests):
        best = None
        for q in allowed.get(group, ()):
            rows = queues.get(q)
            if rows and heads[q] < len(rows) and (best is None or rows[heads[q]] < best[0]):
                best = (rows[heads[q]], q)
        if best:
            heads[best[1]] += 1
            out.append((at, *best))
    return out


def _turn(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """left: requests, and as rules the queues of their groups; right: invoices.  Pairs, and a row for each queue with its number taken."""
    allowed, queues = defaultdict(list), defaultdict(list)
    for g, q in zip(left["grp"][left["rule"]], left["queue"][left["rule"]]):
        allowed[g].append(q)
    ordered = right.sort_values("at")
    for q, at in zip(ordered["queue"], ordered["at"]):
        queues[q].append(at)
    found = walk(list(zip(left["at"][~left["rule"]], left["grp"][~left["rule"]])), queues, allowed)
    taken = defaultdict(int)
    for _, _, q in found:
        taken[q] += 1
    rows = [(key[0], key[1], r, i, q, 0) for r, i, q in found] + [(key[0], key[1], 0, 0, q, n) for q, n in taken.items()]
    return pd.DataFrame(rows, columns=["part", "turn", "request", "invoice", "queue", "taken"]).astype("int64")


def served(requests: DataFrame, invoices: DataFrame, allowed: DataFrame, turn: int | None = None) -> DataFrame:
    """part, request, invoice of the walk.

    requests: part, grp, at; invoices: part, queue, at; allowed: part, grp, queue (distinct).
    Numbers (at) are distinct within a part.
    """
    size = turn or TURN
    asked = saved(ranked(requests.select("part", "grp", "at"), ["part"], ["at"]).withColumn("turn", F.floor((F.col("k") - 1) / size)).drop("k"), "turns")
    offered = saved(ranked(invoices.select("part", "queue", "at"), ["part", "queue"], ["at"], "nth").withColumn("step", F.floor((F.col("nth") - 1) / size)), "offers")
    need = asked.groupBy("part", "turn", "grp").agg(F.count(F.lit(1)).alias("n")).join(allowed, ["part", "grp"]).groupBy("part", "turn", "queue").agg(F.sum("n").alias("need"))
    spread = ranked(invoices.select("part", "queue", "at"), ["part"], ["at"]).groupBy("part", "queue", F.floor((F.col("k") - 1) / size).alias("of")).agg(F.count(F.lit(1)).alias("n"))
    guess = need.join(spread, ["part", "queue"], "left").groupBy("part", "turn", "queue", "need").agg(F.coalesce(F.sum(F.when(F.col("of") < F.col("turn"), F.col("n"))), F.lit(0)).alias("given"))
    guess = saved(guess, "guess")
    groups = asked.select("part", "turn", "grp").distinct().join(allowed, ["part", "grp"])
    zero = F.lit(0).cast("long")
    left = saved(asked.withColumns({"queue": zero, "rule": F.lit(False)}).unionByName(groups.withColumns({"at": zero, "rule": F.lit(True)})), "asked")
    while True:
        steps = F.explode(F.sequence(F.floor(F.col("given") / size), F.floor((F.col("given") + F.col("need") - 1) / size)))
        near = guess.withColumn("step", steps).join(offered, ["part", "queue", "step"]).where("nth > given AND nth <= given + need").select("part", "turn", "queue", "at")
        done = left.groupBy("part", "turn").cogroup(near.groupBy("part", "turn")).applyInPandas(_turn, "part long, turn long, request long, invoice long, queue long, taken long")
        done = saved(done, "served")
        counts = guess.join(done.where("taken > 0").select("part", "turn", "queue", "taken"), ["part", "turn", "queue"], "left")
        before = F.sum(F.coalesce("taken", F.lit(0))).over(W.partitionBy("part", "queue").orderBy("turn").rowsBetween(W.unboundedPreceding, -1))
        after = saved(counts.select("part", "turn", "queue", "need", "given", F.coalesce(before, F.lit(0)).alias("now")), "given")
        if after.where("given <> now").isEmpty():
            return done.where("taken = 0").select("part", "request", "invoice")
        guess = after.drop("given").withColumnRenamed("now", "given")
