"""Invoice texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's name) and text of whole text files."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))


def join_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """doc and text: the pages of each document in order, a line break between them.  Pages with a null text are left out."""
    ordered = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(page).alias("p"), F.col(text).alias("t")))))
    return pages.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("text"))
