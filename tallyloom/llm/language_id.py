"""Language identification by compression.

For each language a raw-content zstandard dictionary is filled with training text.
A text is compressed, block by block, once with each dictionary; the language whose
dictionary gives the fewest bytes wins.  Whole texts are used: blocks keep the
dictionary in reach of every part of a long text, they don't shorten it.

Learning takes a bounded sample: distinct texts of a language in the order of a hash, of a
long text a slice at a hashed place, until its dictionary is full.  So all languages that have
text enough fill dictionaries of one size, whatever the lengths of their texts, and what
reaches the driver is ``dict_bytes`` and a slice per language, and the lengths of the
candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import saved

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageModel:
    """One raw-content dictionary per language, in language order."""

    dictionaries: dict[str, bytes]
    block: int = 2048
    level: int = 6


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for rows kept from learning: crc32 of the id as text leaves 2 when divided by 4.  A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", slice_chars: int = 468, longest: int = 4692, dict_bytes: int = 112_640, cells: int = 4096, block: int = 2048, level: int = 6
) -> LanguageModel:
    """Fill the dictionaries from rows that are not held out and have both a language and a text with a letter.

    Distinct texts of a language fall into ``cells`` by a hash, and the least hash of each
    cell may be learnt from, so copies don't count and candidates stay bounded at every corpus
    size.  They are taken in the order of their hashes, ``slice_chars`` characters of each,
    until they make ``dict_bytes``; of a language with so few texts that these would not do,
    longer slices are taken, up to ``longest``.  Languages without a usable text are left out.
    """
    usable = docs.where(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    start = F.pmod(F.xxhash64("text", F.lit(2)), F.greatest(F.length("text") - longest, F.lit(0)) + 1) + 1
    piece = F.lower(F.substring("text", start.cast("int"), F.lit(longest)))
    least = usable.groupBy("lang", F.pmod("h", F.lit(cells)).alias("cell")).agg(F.min_by(F.struct("h", piece.alias("t")), F.struct("h", piece)).alias("one"))
    least = saved(least.select("lang", "one.*"), "language-slices")
    sizes: dict[str, list[int]] = {}
    for row in least.groupBy("lang", F.octet_length("t").alias("n")).count().collect():  # a row a length, and no more than one a cell
        sizes.setdefault(row["lang"], []).extend([row["n"]] * row["count"])
    spark = docs.sparkSession
    cuts = spark.createDataFrame([(k, max(slice_chars, _level(v, dict_bytes))) for k, v in sizes.items()], "lang string, cut int")
    cut = least.join(F.broadcast(cuts), "lang").withColumn("t", F.substring("t", F.lit(1), F.col("cut")))
    before = F.sum(F.octet_length("t") + 1).over(W.partitionBy("lang").orderBy("h").rowsBetween(W.unboundedPreceding, -1))  # at most a row a cell
    parts: dict[str, list[bytes]] = {}
    for row in cut.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= dict_bytes).orderBy("lang", "h").select("lang", "t").collect():
        parts.setdefault(row["lang"], []).append(row["t"].encode())
    return LanguageModel({k: b"\n".join(v)[:dict_bytes] for k, v in sorted(parts.items())}, block, level)


def _level(sizes: list[int], total: int) -> int:
    """The length to which texts of these sizes have to be cut to make ``total`` together."""
    left, cut = total, 0
    for k, n in enumerate(sorted(sizes)):
        cut = -(-max(left, 0) // (len(sizes) - k))
        if n >= cut:
            return cut
        left -= n
    return max(sizes, default=0)


class _Scorer:
    def __init__(self, model: LanguageModel):
        self.langs = list(model.dictionaries)
        self.block = model.block
        self.coders = []
        for raw in model.dictionaries.values():
            data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=model.level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, raw: bytes) -> list[int]:
        parts = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.coders]


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None, margin: float = 0.004) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` to the columns in ``keep`` (all by default).

    score is the share of the best language in exp(-bytes above the best / 8).  A text
    that is null or has no letter is ``und`` with score 0 and rejected; a text whose two
    best sizes differ by less than ``margin`` of the best, and by less than two bytes,
    keeps its best language (ties: first by name) and is rejected too.  Columns of the
    three names are replaced.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score", "rejected")]
    fields = [docs.schema[c] for c in keep]
    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    payload = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            preds, scores, rejected = [], [], []
            for value in batch.column("__text"):
                t = value.as_py()
                if t is None or not scorer.langs or _LETTER.search(t) is None:
                    preds.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
                sizes = np.array(scorer.sizes(t.lower().encode()), dtype=float)
                best = int(sizes.argmin())
                above = sizes - sizes[best]
                gap = float(np.partition(above, 1)[1]) if len(sizes) > 1 else float("inf")
                preds.append(scorer.langs[best])
                scores.append(float(1.0 / np.exp(-above / 8.0).sum()))
                rejected.append(gap < 2 and gap < margin * sizes[best])
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=schema.names)

    return payload.mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score, rejected."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep=["doc_id", "held_out"])
