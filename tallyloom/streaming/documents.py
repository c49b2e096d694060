"""Amounts of documents as they arrive.  Reading amounts keeps no state, so a stream is read like a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.money import extract_total
from ..functions.text import fold_text
from ..storage import shared_folder


def totals(docs: DataFrame) -> DataFrame:
    """doc_id and payable total of a table or stream of documents."""
    return docs.select("doc_id", extract_total(fold_text(F.col("text"))).alias("total_amount"))


def watch_totals(spark: SparkSession, source: str, target: str, name: str) -> StreamingQuery:
    """Follow Parquet files of documents (doc_id, text) and append their totals; progress is kept in the shared folder."""
    schema = "doc_id long, text string"
    stream = totals(spark.readStream.schema(schema).parquet(source))
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{shared_folder(spark)}/streams/{name}").trigger(availableNow=True).start()
