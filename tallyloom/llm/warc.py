"""WARC archives: writing pages as records, and reading records back by boundary chains.

Writing is one pass of string columns into the text writer, whose line separator is the
blank lines that end a record.  Pages with equal payloads are written once; the others
become revisit records.

Reading can't trust the magic line, because a payload may hold it.  So tasks split the
files at every magic and emit, for each candidate, its own offset and that of its
successor by its Content-Length.  From the start of each file, pointer jumping over these
offsets finds what can be reached in a logarithmic number of joins; all other candidates
are parts of payloads.  Payloads are hashed where they are read and never shuffled, except
those that hold the magic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import new_folder, saved

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
#: Fixed value: the profile of revisits whose payload is that of another record.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Digits of numbers in base 32, and the alphabet that base32 text has for them.
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Characters that some reader may take for the end of a line, percent-encoded.
_BREAKS = {c: "".join(f"%{b:02X}" for b in c.encode()) for c in "\r\n\x0b\x0c\x85\u2028\u2029"}
#: Revisits up to this many are broadcast (16 bytes each); beyond, pages are joined by shuffle.
MOST_BROADCAST = 100_000


def base32_sha1(data: Column) -> Column:
    """SHA-1 of a string or binary column in upper-case base32: 40 bits, or 8 digits, at a time."""
    digest = F.sha1(data.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def _http(size: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"))


def with_record_type(pages: DataFrame, least_payload: int = 0) -> DataFrame:
    """Add record_type and refers_to to pages with page_id and html.

    Of equal payloads of at least ``least_payload`` bytes the smallest page_id is response,
    and the others revisit it.  A null html is an empty payload; rows that repeat the
    smallest id are responses too; a null id is never the smallest where another exists.
    """
    payload = F.coalesce("html", F.lit(""))
    keys = pages.select("page_id", F.octet_length(payload).alias("__bytes"), F.sha2(payload.cast("binary"), 256).alias("__sha")).where(F.col("__bytes") >= least_payload)
    groups = keys.groupBy("__bytes", "__sha").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = keys.join(groups, ["__bytes", "__sha"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("__page"), F.col("__bytes").alias("__size"), F.col("__sha").alias("__of"), "refers_to").distinct()
    copies = saved(copies, "copies")
    # an id may stand for several pages: the payload tells them apart
    side = F.broadcast(copies) if copies.count() <= MOST_BROADCAST else copies
    same = F.col("page_id").eqNullSafe(F.col("__page")) & (F.octet_length(payload) == F.col("__size")) & (F.sha2(payload.cast("binary"), 256) == F.col("__of"))
    kind = F.when(F.col("__of").isNull(), "response").otherwise("revisit")
    return pages.join(side, same, "left").withColumn("record_type", kind).drop("__page", "__size", "__of")


def write(pages: DataFrame, path: str, least_payload: int = 0, records_a_file: int = 4096) -> None:
    """Write a record per row of pages (page_id, url, html).

    Line breaks in a url, those beyond ASCII too, are percent-encoded; a null url or id
    leaves its field out.
    """
    typed = with_record_type(pages.select("page_id", "url", "html"), least_payload)
    payload = F.coalesce("html", F.lit(""))
    http = F.concat(_http(F.octet_length(payload)), F.lit(END))
    block = F.when(F.col("record_type") == "response", F.concat(http, payload)).otherwise(http)
    uri = F.col("url")
    for mark, code in _BREAKS.items():
        uri = F.replace(uri, F.lit(mark), F.lit(code))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.concat_ws(
        "\r\n",
        F.lit(MAGIC[:-2]),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", page("page_id")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        field("WARC-Target-URI", uri),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(payload))),
        F.when(F.col("record_type") == "revisit", F.concat_ws("\r\n", field("WARC-Refers-To", page("refers_to")), F.lit(f"WARC-Profile: {PROFILE}"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        field("Content-Length", F.octet_length(block).cast("string")),
    )
    typed.select(F.concat(head, F.lit(END), block).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_a_file).text(path)


def _field(head: Column, name: str) -> Column:
    # (?d): only \n ends a line, not U+0085, U+2028 or U+2029, which a url may hold
    found = F.regexp_extract(head, rf"(?imd)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magics, with the place of each: file, block and order."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value")


def _parsed(value: Column) -> dict[str, Column]:
    """Columns of a record's text, from behind its magic to the blank lines that end it."""
    head = F.substring_index(value, END, 1)
    block = F.substr(value, F.length(head) + 5)
    http = F.substring_index(block, END, 1)
    body = F.substr(block, F.length(http) + 5)
    body = F.left(body, F.greatest(F.length(body) - 4, F.lit(0)))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    kind = _field(head, "WARC-Type")
    told = F.regexp_extract(_field(head, "WARC-Payload-Digest"), r"^sha1:(.*)$", 1)
    return {
        "page_id": page(_field(head, "WARC-Record-ID")),
        "url": _field(head, "WARC-Target-URI"),
        "record_type": kind,
        "refers_to": page(_field(head, "WARC-Refers-To")),
        "payload_bytes": F.when(kind == "revisit", _field(http, "Content-Length").try_cast("long")).otherwise(F.octet_length(body).cast("long")),
        "payload_digest": F.when(kind == "revisit", told).otherwise(base32_sha1(body)),
        "__body": body,
    }


def reachable(candidates: DataFrame) -> DataFrame:
    """Pointer jumping: (file, at) of the candidates that a chain of successors from offset 0 reaches.

    candidates has file, at and next; each round doubles the length of the jumps.
    """
    now = saved(candidates.select("file", "at", F.col("next").alias("jump"), (F.col("at") == 0).alias("hit")), "jumps")
    while now.where("jump IS NOT NULL").limit(1).count():
        far = now.select("file", F.col("at").alias("jump"), F.col("jump").alias("farther"), F.lit(True).alias("there"))
        moved = now.join(far, ["file", "jump"], "left")
        marks = moved.where("there AND hit").select("file", F.col("jump").alias("at"), F.lit(None).cast("long").alias("jump"), F.lit(True).alias("hit"))
        rest = moved.select("file", "at", F.col("farther").alias("jump"), "hit")
        now = saved(rest.unionByName(marks).groupBy("file", "at").agg(F.max("jump").alias("jump"), F.max("hit").alias("hit")), "jumps")
    return now.where("hit").select("file", "at")


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Records of the archives under a path: page_id, url, record_type, refers_to, payload_bytes, payload_digest, and payload if asked for.

    Digests of responses are those of the payloads that were read.  A file that does not
    begin with a record yields none; a record whose length leads to no other record, or to
    the file's end, ends its chain.
    """
    chunks = _chunks(spark, path)
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    parsed = _parsed(F.col("value"))
    head = F.substring_index("value", END, 1)
    small = chunks.select(
        "file", "block", "nth", F.octet_length("value").cast("long").alias("size"), (F.octet_length(head) + len(END)).alias("head_size"), _field(head, "Content-Length").try_cast("long").alias("content"), *(parsed[c].alias(c) for c in names), *([parsed["__body"].alias("payload")] if payload else [])
    )
    small = saved(small, "candidates")
    order = W.partitionBy("file").orderBy("block", "nth")
    # offset of a candidate's magic: all that stands before it, magics included
    before = F.sum(F.col("size") + len(MAGIC)).over(order.rowsBetween(W.unboundedPreceding, -1))
    placed = small.withColumn("at", before - len(MAGIC)).where("at IS NOT NULL")
    placed = placed.withColumn("next", F.col("at") + len(MAGIC) + F.col("head_size") + F.col("content") + len(END))
    found = reachable(placed.select("file", "at", "next"))
    records = placed.join(found, ["file", "at"])
    own = F.col("at") + len(MAGIC) + F.col("size")
    whole = records.where(F.col("next") == own).select(*names, *(["payload"] if payload else []))

    # payloads that hold a magic: their chunks are put together again
    cut = saved(records.where(F.col("next") > own).select("file", F.col("at").alias("first"), F.col("next").alias("end")), "cut")
    if not cut.limit(1).count():
        return whole
    parts = placed.select("file", "block", "nth", "at").join(cut, "file").where("at >= first AND at < end").select("file", "block", "nth", "at", "first")
    texts = chunks.join(parts, ["file", "block", "nth"])
    joined = texts.groupBy("file", "first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda c: c["value"]), MAGIC).alias("value"))
    again = _parsed(F.col("value"))
    return whole.unionByName(joined.select(*(again[c].alias(c) for c in names), *([again["__body"].alias("payload")] if payload else [])))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC archives and back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = new_folder(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
