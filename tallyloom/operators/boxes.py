"""Text lines from the word boxes of a page, in column functions: one shuffle by page, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN = "struct<open:array<struct<n:int,top:double,bottom:double>>,next:int,out:array<int>>"
_LINES = "struct<done:array<string>,n:int,text:string,edge:double>"
_EDGE_BLANKS = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"


def _fits(box: Column, band: Column, overlap: float) -> Column:
    """Whether the box shares enough of the lower of both heights with the band."""
    shared = F.least(box["bottom"], band["bottom"]) - F.greatest(box["top"], band["top"])
    lower = F.greatest(F.least(box["bottom"] - box["top"], band["bottom"] - band["top"]), F.lit(1.0))
    return (shared > 0) & (shared / lower >= overlap)


def band_numbers(boxes: Column, overlap: float) -> Column:
    """The row of each box: boxes come from the top on, and each goes to the first band that it fits, which it widens.

    A band that ends above a box can't be fitted any more, by this box or a later one, so
    only bands that are open go along.  Bands are numbered in the order of their tops.
    """

    def add(so_far: Column, box: Column) -> Column:
        live = F.filter(so_far["open"], lambda b: b["bottom"] > box["top"])
        home = F.get(F.filter(live, lambda b: _fits(box, b, overlap)), F.lit(0))["n"]
        wider = F.transform(live, lambda b: F.when(b["n"] == home, F.struct(b["n"].alias("n"), b["top"].alias("top"), F.greatest(b["bottom"], box["bottom"]).alias("bottom"))).otherwise(b))
        fresh = F.concat(live, F.array(F.struct(so_far["next"].alias("n"), box["top"].alias("top"), box["bottom"].alias("bottom"))))
        return F.struct(
            F.when(home.isNull(), fresh).otherwise(wider).alias("open"),
            (so_far["next"] + home.isNull().cast("int")).alias("next"),
            F.concat(so_far["out"], F.array(F.coalesce(home, so_far["next"]))).alias("out"),
        ).cast(_OPEN)

    start = F.struct(F.array().alias("open"), F.lit(0).alias("next"), F.array().alias("out")).cast(_OPEN)
    return F.aggregate(boxes, start, add, lambda done: done["out"])


def line_texts(words: Column, gap: float) -> Column:
    """The lines of words (band, left, at, right, text) in order: two blanks where the gap is over ``gap``, one where there is any, else none."""

    def add(so_far: Column, word: Column) -> Column:
        goes_on = so_far["n"] == word["band"]
        free = word["left"] - so_far["edge"]
        blanks = F.when(~goes_on, F.lit("")).when(free > gap, F.lit("  ")).when(free > 0, F.lit(" ")).otherwise(F.lit(""))
        before = F.when(goes_on, so_far["text"]).otherwise(F.lit(""))
        text = F.when(word["text"] == "", before).otherwise(F.concat(before, blanks, word["text"]))
        done = F.when(goes_on, so_far["done"]).otherwise(F.concat(so_far["done"], F.array(so_far["text"])))
        return F.struct(done.alias("done"), word["band"].alias("n"), text.alias("text"), word["right"].alias("edge")).cast(_LINES)

    start = F.struct(F.array().alias("done"), F.lit(-1).alias("n"), F.lit("").alias("text"), F.lit(None).alias("edge")).cast(_LINES)
    return F.aggregate(words, start, add, lambda end: F.transform(F.concat(end["done"], F.array(end["text"])), lambda t: F.regexp_replace(t, _EDGE_BLANKS, "")))


def boxes_to_lines(boxes: DataFrame, overlap: float = 0.5, gap: float = 24.0) -> DataFrame:
    """doc_id, page_no, line_no, line of boxes (doc_id, page_no, top, bottom, left, right, text).

    Boxes with a null edge are left out; a null text is empty, and takes its place in the row
    without a word.  Rows without text give no line.  Boxes of one place go by right edge and
    text.  A page's boxes are one array.
    """
    edges = boxes.dropna(subset=["top", "bottom", "left", "right"])
    box = F.struct(*(F.col(c).cast("double").alias(c) for c in ("top", "left", "bottom", "right")), F.coalesce("text", F.lit("")).alias("text"))
    pages = edges.groupBy("doc_id", F.col("page_no").cast("int").alias("page_no")).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    placed = pages.withColumn("bands", band_numbers(F.col("boxes"), overlap))
    word = lambda b, i: F.struct(F.get("bands", i).alias("band"), b["left"].alias("left"), i.alias("at"), b["right"].alias("right"), b["text"].alias("text"))
    lines = line_texts(F.array_sort(F.transform("boxes", word)), gap)
    return placed.select("doc_id", "page_no", F.posexplode(F.filter(lines, lambda t: t != "")).alias("line_no", "line"))
