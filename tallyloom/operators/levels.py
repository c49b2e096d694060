"""The greedy one-to-one assignment of large parts, level of score by level, as joins and walks of bounded size.

The greedy order takes pairs by falling score, then request, then invoice.  Scores belong to
pairs of classes, once for rows whose amounts agree and once for any others, so a pair of
classes has one or two levels.  A level of a class is due when it is the highest that the
class has left.  Pairs of classes at one level form groups; a group in which the level is due
for all of its classes depends on nothing else, and all such groups are settled side by side.

At the level of agreeing amounts only rows whose amounts lie within the tolerance meet, which
splits a group into small parts.  Where amounts don't count, a group is a part; by then no
two of its rows agree, as the higher level of agreeing amounts has paired all that could.
Within a part all scores are equal: first come, first served (see ``queues``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import saved
from . import queues
from .components import components
from .ranks import ranked

_FOUND = "root long, row_number long, invoice_seq long"


def _node(side: str, *columns: str) -> Column:
    return F.xxhash64(F.lit(side), *columns)


def level_edges(pairs: DataFrame, floor: float, least: float) -> DataFrame:
    """rc, ic, agree, level: one or two levels of each class pair (sim, account_evidence), of ``least`` or more."""
    plain = F.when(F.col("account_evidence"), F.greatest("sim", F.lit(floor)) + 0.1).otherwise(F.col("sim"))
    others, agreeing = F.least(plain, F.lit(1.0)), F.least(plain + 0.05, F.lit(1.0))
    level = lambda agree, score: F.struct(F.lit(agree).alias("agree"), score.alias("level"))
    both = F.when(others == agreeing, F.array(level(False, others))).otherwise(F.array(level(True, agreeing), level(False, others)))
    return pairs.select("rc", "ic", F.explode(both).alias("l")).select("rc", "ic", "l.agree", "l.level").where(F.col("level") >= least)


def _due(edges: DataFrame) -> DataFrame:
    """grp, rc, ic, agree, level, mixed: edges of the groups that no higher level holds up; mixed groups have both kinds of edges."""
    tops = [edges.groupBy(c).agg(F.max("level").alias(f"top_{c}")) for c in ("rc", "ic")]
    near = edges.join(tops[0], "rc").join(tops[1], "ic").where((F.col("level") == F.col("top_rc")) | (F.col("level") == F.col("top_ic")))
    near = saved(near.withColumns({"a": _node("r", "rc", "level"), "b": _node("i", "ic", "level")}), "levels-near")
    groups = components(near.select("a", "b")).select(F.col("node").alias("a"), F.col("root").alias("grp"))
    placed = saved(near.join(groups, "a"), "levels-placed")
    state = placed.groupBy("grp").agg(F.max(F.col("level") < F.greatest("top_rc", "top_ic")).alias("held"), (F.min("agree") != F.max("agree")).alias("mixed")).where("NOT held")
    return saved(placed.join(state, "grp").select("grp", "rc", "ic", "agree", "level", "mixed"), "levels-due")


def _by_amount(r: DataFrame, i: DataFrame, edges: DataFrame, tolerance: int) -> DataFrame:
    """Pairs where only rows with agreeing amounts meet."""
    rows = lambda d, c, to: saved(d.join(edges.select(c).distinct(), c).select("root", c, "cents", "at", _node(to, c, "cents").alias(to)), "level-rows")
    asking, offered = rows(r, "rc", "grp"), rows(i, "ic", "queue")
    around = F.explode(F.sequence(F.col("cents") - tolerance, F.col("cents") + tolerance))
    near = asking.select("rc", "cents", "grp").distinct().withColumn("cents", around).join(edges.select("rc", "ic"), "rc").join(offered.select("ic", "cents", "queue").distinct(), ["ic", "cents"])
    return _serve(asking, offered, saved(near.select("grp", "queue").distinct(), "allowed"))


def _by_class(r: DataFrame, i: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs where all rows of linked classes meet."""
    rows = lambda d, c, to: saved(d.join(edges.select(c).distinct(), c).select("root", F.col(c).alias(to), "at"), "level-rows")
    return _serve(rows(r, "rc", "grp"), rows(i, "ic", "queue"), edges.select(F.col("rc").alias("grp"), F.col("ic").alias("queue")))


def _serve(asking: DataFrame, offered: DataFrame, allowed: DataFrame) -> DataFrame:
    parts = saved(components(allowed.select(_node("g", "grp").alias("a"), _node("q", "queue").alias("b"))), "walk-parts")
    own = lambda d, side, c: d.withColumn("node", _node(side, c)).join(parts.withColumnRenamed("root", "part"), "node").drop("node")
    mine = own(asking, "g", "grp")
    found = queues.served(mine, own(offered, "q", "queue"), own(allowed, "g", "grp"))
    return found.join(mine.select("part", "root").distinct(), "part").select("root", F.col("request").alias("row_number"), F.col("invoice").alias("invoice_seq"))


def _mixed_turn(tolerance: int):
    def turn(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        free, gone, allowed, heads, out = {}, set(), {}, {}, []
        for ic, cents, at in right.sort_values("at")[["ic", "cents", "at"]].itertuples(index=False):
            free.setdefault((ic, None), []).append(at)
            free.setdefault((ic, cents), []).append(at)
        rules = left[left["rule"]]
        for rc, ic, agree in zip(rules["rc"], rules["ic"], rules["agree"]):
            allowed.setdefault(rc, []).append((ic, bool(agree)))
        rows = left[~left["rule"]].sort_values("at")
        for root, at, rc, cents in rows[["root", "at", "rc", "cents"]].itertuples(index=False):
            best = None
            for ic, agree in allowed[rc]:
                for q in [(ic, c) for c in range(cents - tolerance, cents + tolerance + 1)] if agree else [(ic, None)]:
                    queue, h = free.get(q, ()), heads.get(q, 0)
                    while h < len(queue) and queue[h] in gone:
                        h += 1
                    heads[q] = h
                    if h < len(queue) and (best is None or queue[h] < best):
                        best = queue[h]
            if best is not None:
                gone.add(best)
                out.append((root, at, best))
        return pd.DataFrame(out, columns=["root", "row_number", "invoice_seq"]).astype("int64")

    return turn


def _mixed(r: DataFrame, i: DataFrame, edges: DataFrame, tolerance: int) -> DataFrame:
    """Pairs of groups in which some classes meet by amount and some whatever the amount: turn after turn.

    Such a group takes invoices out of the order of their queues, so a turn needs what the
    one before has left.  It brings its requests together with as many of the first invoices
    of a class as may be taken from it, and beyond those with as many of an amount as
    requests ask for by amount.
    """
    asking = saved(r.join(edges.select("grp", "rc").distinct(), "rc").select("grp", "root", "rc", "cents", "at"), "asking")
    offered = saved(i.join(edges.select("grp", "ic").distinct(), "ic").select("grp", "ic", "cents", "at"), "offered")
    found = asking.sparkSession.createDataFrame([], _FOUND)
    while not asking.isEmpty():
        dealt = saved(ranked(asking, ["grp"], ["at"]), "turns")
        now, later = dealt.where(F.col("k") <= queues.TURN).drop("k"), dealt.where(F.col("k") > queues.TURN).drop("k")
        wanted = saved(now.groupBy("grp", "rc", "cents").agg(F.count(F.lit(1)).alias("n")).join(edges.select("grp", "rc", "ic", "agree"), ["grp", "rc"]), "wanted")
        around = F.explode(F.sequence(F.col("cents") - tolerance, F.col("cents") + tolerance))
        some = wanted.where("agree").withColumn("cents", around).groupBy("grp", "ic", "cents").agg(F.sum("n").alias("some"))
        every = wanted.groupBy("grp", "ic").agg(F.sum(F.when(~F.col("agree"), F.col("n"))).alias("asks"), F.sum("n").alias("every")).where("asks > 0")
        flagged = saved(ranked(offered, ["grp", "ic"], ["at"]).join(every, ["grp", "ic"], "left").withColumn("first", F.coalesce(F.col("k") <= F.col("every"), F.lit(False))).select("grp", "ic", "cents", "at", "first"), "offers")
        beyond = ranked(flagged.where("NOT first").select("grp", "ic", "cents", "at"), ["grp", "ic", "cents"], ["at"]).join(some, ["grp", "ic", "cents"]).where("k <= some")
        near = flagged.where("first").select("grp", "ic", "cents", "at").unionByName(beyond.select("grp", "ic", "cents", "at"))
        rules = edges.join(now.select("grp", "rc").distinct(), ["grp", "rc"]).select("grp", "rc", "ic", "agree", *(F.lit(0).cast("long").alias(c) for c in ("root", "cents", "at")), F.lit(True).alias("rule"))
        left = now.withColumns({"ic": F.lit(0).cast("long"), "agree": F.lit(False), "rule": F.lit(False)}).unionByName(rules)
        done = saved(left.groupBy("grp").cogroup(near.groupBy("grp")).applyInPandas(_mixed_turn(tolerance), _FOUND), "served")
        found = found.unionByName(done)
        gone = done.join(now.select("grp", "root").distinct(), "root").select("grp", F.col("invoice_seq").alias("at"))
        asking, offered = saved(later, "asking"), saved(offered.join(gone, ["grp", "at"], "left_anti"), "offered")
    return found


def by_levels(requests: DataFrame, invoices: DataFrame, pairs: DataFrame, tolerance: int, floor: float, least: float = 0.0) -> DataFrame:
    """root, row_number, invoice_seq, rc, ic, r_cents, i_cents, confidence of the greedy assignment.

    requests: root, at, rc, cents; invoices: root, at, ic, cents; pairs: rc, ic, sim,
    account_evidence.  at is distinct within a root; a class belongs to one root.
    """
    edges = saved(level_edges(pairs, floor, least), "level-edges")
    r, i = (saved(d, "level-rows") for d in (requests, invoices))
    kept = []
    while True:
        # only classes with rows that are left can meet
        edges = saved(edges.join(r.select("rc").distinct(), "rc", "left_semi").join(i.select("ic").distinct(), "ic", "left_semi"), "level-edges")
        if edges.isEmpty():
            break
        due = _due(edges)
        kinds = {(x["mixed"], x["agree"]) for x in due.select("mixed", "agree").distinct().collect()}
        found = []
        if (False, True) in kinds:
            found.append(_by_amount(r, i, due.where("NOT mixed AND agree"), tolerance))
        if (False, False) in kinds:
            found.append(_by_class(r, i, due.where("NOT mixed AND NOT agree")))
        if (True, True) in kinds:
            found.append(_mixed(r, i, due.where("mixed"), tolerance))
        pairs_found = found[0]
        for more in found[1:]:
            pairs_found = pairs_found.unionByName(more)
        told = pairs_found.join(r.select("root", F.col("at").alias("row_number"), "rc", F.col("cents").alias("r_cents")), ["root", "row_number"])
        told = told.join(i.select("root", F.col("at").alias("invoice_seq"), "ic", F.col("cents").alias("i_cents")), ["root", "invoice_seq"])
        told = saved(told.join(due.select("rc", "ic", F.col("level").alias("confidence")).distinct(), ["rc", "ic"]), "level-found")
        kept.append(told)
        r = saved(r.join(told.select("root", F.col("row_number").alias("at")), ["root", "at"], "left_anti"), "level-rows")
        i = saved(i.join(told.select("root", F.col("invoice_seq").alias("at")), ["root", "at"], "left_anti"), "level-rows")
        edges = edges.join(due.select("rc", "ic", "agree"), ["rc", "ic", "agree"], "left_anti")
    out = kept[0] if kept else None
    for more in kept[1:]:
        out = out.unionByName(more)
    empty = r.limit(0).join(i.limit(0).select("ic", F.col("at").alias("invoice_seq"), F.col("cents").alias("i_cents")), F.col("rc") == F.col("ic"))
    return out if out is not None else empty.select("root", F.col("at").alias("row_number"), "invoice_seq", "rc", "ic", F.col("cents").alias("r_cents"), "i_cents", F.lit(0.0).alias("confidence"))
