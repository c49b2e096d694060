"""A corpus pipeline of five stages: toxicity, language ID, near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a table that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import language_id, minhash_dedup, packing, suffix_dedup, toxicity
from tallyloom.storage import saved

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with about 4 MB in an Arrow batch where the session sets no size of its own.

    Batches end at 10,000 rows otherwise, of whole texts and of pairs of shingle sets,
    whatever they hold.  An executor keeps several copies of the batches of all its tasks
    outside the heap.  The setting stays: the last stage runs after it is returned.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(_BATCH, None) is None:
            spark.conf.set(_BATCH, "4m")
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic.  A null text is kept."""
    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.score(docs, model).where(F.col("predicted") == 0).select(*docs.columns)


@in_small_batches
def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; texts that are null or without a letter, or with a tie of languages, go.

    Rows are judged one by one, so rows of a repeated or null id stay or go by their texts;
    other columns pass through.
    """
    return language_id.predict(docs, language_id.fit(docs)).where(~F.col("rejected")).select(*docs.columns)


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, in five words and a similarity of 0.8: the one with the smallest id.

    Null and empty texts are like nothing and stay; rows of a repeated id stay or go
    together; other columns pass through.
    """
    return minhash_dedup.one_of_each(docs, width=5, percent=80)


@in_small_batches
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages of over 50 words (or of 400 bytes) that occur more than once; n_chars counts what is left.

    A passage is a run of bytes in which each is covered by a 200-byte string that starts
    anywhere else too: 51 words of three letters and a space have more.  Null and empty texts
    have nothing to cut (a null one comes back empty); rows of a repeated or null id are cut
    each; other columns pass through.
    """
    return suffix_dedup.without_repeats(docs, size=200, gram=64, least_words=51).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@in_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens.

    A null text is empty and has its end id alone; rows of a repeated or null id are packed
    each; other columns are left out.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
