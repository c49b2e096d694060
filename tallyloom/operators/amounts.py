"""Requests take the only free invoice of their amount, in turn: a sweep over sorted amounts.

An amount at which requests wait is a place; the invoices within the tolerance of it are its
choices.  Invoices are only ever taken, so a place serves one request at most: the first that
comes after all choices but one are gone.  Which one that is depends on neighbouring places
alone.  Places are cut into pieces by ranges of amounts, many islands of neighbours or a part of
a long one to a piece, and each piece is walked through by itself, in the order of requests.
Invoices that places of two pieces can see are their border: what one piece takes there, and
when, the other is told, and pieces with a border walk again until nothing they tell changes.
The earliest such message is right after the first walk, and each walk makes at least the
next one right.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved

#: Requests in a piece, about; a place is never cut, and carries 8 bytes a request.
PIECE_ROWS = 100_000
_TAKEN = "piece int, batch_id string, ic long, row_number long, invoice_seq long"


def walk(places: list[tuple[str, list[int], list[int]]], told: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(batch, amount taken, request) of a piece.

    places: (batch, amounts of the choices, requests in order); told: (batch, amount, request) taken by others.
    """
    seen, free, events, taken, out = defaultdict(list), [], [], set(), []
    for k, (batch, choices, rows) in enumerate(places):
        free.append(len(choices))
        for c in choices:
            seen[batch, c].append(k)
        if len(choices) == 1:
            heappush(events, (rows[0], k, -1))
    for k, (_, _, at) in enumerate(told):
        heappush(events, (at, -1, k))
    while events:
        at, place, message = heappop(events)
        if message >= 0:
            value = told[message][:2]
            if value in taken:
                continue
        else:
            if free[place] != 1:
                continue
            batch, choices, _ = places[place]
            value = next((batch, c) for c in choices if (batch, c) not in taken)
            out.append((*value, at))
        taken.add(value)
        for k in seen[value]:
            free[k] -= 1
            rows = places[k][2]
            if free[k] == 1 and (nth := bisect_right(rows, at)) < len(rows):
                heappush(events, (rows[nth], k, -1))
    return out


def _piece(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    number = {(b, c): s for b, choices in zip(left["batch_id"], left["choices"]) for c, s in ((x["ic"], x["invoice_seq"]) for x in choices)}
    places = [(b, [x["ic"] for x in choices], list(rows)) for b, choices, rows in zip(left["batch_id"], left["choices"], left["rows"])]
    found = walk(places, list(zip(right["batch_id"], right["ic"], right["row_number"])))
    return pd.DataFrame([(key[0], b, c, at, number[b, c]) for b, c, at in found], columns=["piece", "batch_id", "ic", "row_number", "invoice_seq"])


def only_choices(requests: DataFrame, invoices: DataFrame, tolerance: int) -> DataFrame:
    """batch_id, row_number, invoice_seq.

    requests: batch_id, row_number, rc (cents); invoices: batch_id, invoice_seq, ic; row
    numbers and invoice numbers are distinct within a batch.  Invoices of one amount hide each
    other for good: no request can take one of them while the other is free.
    """
    spark = requests.sparkSession
    bucket = lambda c: F.floor(F.col(c) / (tolerance + 1)).cast("long")
    values = invoices.groupBy("batch_id", "ic").agg(F.count(F.lit(1)).alias("n"), F.min("invoice_seq").alias("invoice_seq"))
    waits = requests.groupBy("batch_id", "rc").agg(F.count(F.lit(1)).alias("waiting"), F.min("row_number").alias("first"))
    near = waits.withColumn("bucket", F.explode(F.array(*(bucket("rc") + k for k in (-1, 0, 1))))).join(values.withColumn("bucket", bucket("ic")), ["batch_id", "bucket"]).where(F.abs(F.col("rc") - F.col("ic")) <= tolerance)
    places = near.groupBy("batch_id", "rc").agg(F.max("n").alias("n"), F.max("waiting").alias("waiting"), F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("ic", "invoice_seq"))).alias("choices")).where("n = 1").drop("n")
    places = saved(places, "amount-places")
    # where there is one choice the first request takes it; elsewhere it depends on what neighbours take
    clear = places.where(F.size("choices") == 1).withColumn("rows", F.array("first"))
    open_ = places.where(F.size("choices") > 1)
    lists = requests.join(open_.select("batch_id", "rc"), ["batch_id", "rc"]).groupBy("batch_id", "rc").agg(F.array_sort(F.collect_list("row_number")).alias("rows"))
    columns = ["batch_id", "rc", "choices", "rows"]
    all_ = clear.select(columns).unionByName(open_.join(lists, ["batch_id", "rc"]).select(columns))
    pieces = -(-int(places.agg(F.sum(F.when(F.size("choices") == 1, 1).otherwise(F.col("waiting")))).first()[0] or 0) // PIECE_ROWS)
    dealt = saved(all_.repartitionByRange(max(1, pieces), "batch_id", "rc").withColumn("piece", F.spark_partition_id()), "amount-pieces")

    seen = dealt.select("piece", "batch_id", F.explode("choices.ic").alias("ic")).distinct()
    shared = seen.groupBy("batch_id", "ic").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("batch_id", "ic")
    border = saved(seen.join(shared, ["batch_id", "ic"]).withColumnRenamed("piece", "other"), "amount-borders")
    told = spark.createDataFrame([], "piece int, batch_id string, ic long, row_number long")
    run = lambda rows, told: saved(rows.groupBy("piece").cogroup(told.groupBy("piece")).applyInPandas(_piece, _TAKEN), "amounts-taken")
    taken = run(dealt, told)
    result = ["batch_id", "row_number", "invoice_seq"]
    if border.isEmpty():
        return taken.select(result)
    ours = border.select(F.col("other").alias("piece")).distinct()
    inner, done = dealt.join(ours, "piece", "left_semi"), taken.join(ours, "piece", "left_anti")
    while True:
        tell = saved(taken.join(border, ["batch_id", "ic"]).where("other <> piece").select(F.col("other").alias("piece"), "batch_id", "ic", "row_number"), "amounts-told")
        if tell.exceptAll(told).isEmpty() and told.exceptAll(tell).isEmpty():
            return done.select(result).unionByName(taken.join(ours, "piece", "left_semi").select(result))
        told, taken = tell, run(inner, tell)
