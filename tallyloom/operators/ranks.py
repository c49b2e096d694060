"""Ranks within keys of any size: no key has to fit into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import saved


def ranked(rows: DataFrame, keys: list[str], order: list[str], to: str = "k") -> DataFrame:
    """Add ``to``: the place of each row among those of its keys, from 1, by ``order``.

    Rows are dealt out by ranges of keys and order, so a key with many rows lies in several
    neighbouring ranges.  Each range is numbered by itself; what a range adds is the number of
    rows that its first key has in the ranges before, one number a range, which is summed
    up from one row a range.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(rows.repartitionByRange(n, *keys, *order).withColumn("range", F.spark_partition_id()), "ranges")
    key = F.struct(*keys)
    ends = dealt.groupBy("range").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    ends = dealt.join(F.broadcast(ends), "range").groupBy("range", "first", "last").agg(F.count_if(key == F.col("last")).alias("n")).collect()  # one row a range
    before, running, count = [], None, 0
    for r in sorted(ends, key=lambda r: r["range"]):
        if r["first"] == running:
            before.append((r["range"], *r["first"], count))
        count = count + r["n"] if r["last"] == running else r["n"]
        running = r["last"]
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    more = F.broadcast(spark.createDataFrame(before, f"range int, {kinds}, before long"))
    own = F.row_number().over(W.partitionBy("range", *keys).orderBy(*order))
    return dealt.withColumn("own", own).join(more, ["range", *keys], "left").withColumn(to, F.col("own") + F.coalesce("before", F.lit(0))).select(*rows.columns, to)
