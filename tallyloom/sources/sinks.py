"""Payment files, audit tables and JSON results, a folder for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import saved

# Columns of the payment file and of the audit table.
BANK_COLUMNS = {"request_no": "Payment Request No", "payee_name": "Payee Name", "bank_id": "Bank Code and Account Number", "amount": "Payment Amount (HKD)"}
AUDIT_COLUMNS = {
    "request_no": "Payment Request No", "payee_name": "Payee Name", "bank_id": "Bank Code and Account Number", "requested": "Requested Amount (HKD)", "invoice_file": "Invoice File", "invoice_amount": "Invoice Amount (HKD)",
    "difference": "Difference (HKD)", "status_label": "Status", "read_via": "Read Via", "confidence": "Match Confidence", "remarks": "Remarks",
}


def titled(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """batch_id, row_number and the titled columns."""
    return rows.select("batch_id", "row_number", *(F.col(c).alias(t) for c, t in columns.items()))


_CSV = {"header": True, "escape": '"', "enforceSchema": True}


def write_batches(rows: DataFrame, columns: dict[str, str], path: str, reference: str = "", totals: DataFrame | None = None) -> DataFrame:
    """CSV files with a header below ``path``/``reference``_bank_payment_file, and their manifest.

    A batch is a folder, with numbered parts: rows are dealt out by ranges of (batch,
    row_number), so a large batch is written by many tasks, and parts in the order of their
    numbers, rows in the order of the file, are the batch in order.  The rows of ``totals``
    (batch_id and the same columns) follow the lines, as a section of their own that is
    written last.  The manifest (batch_id, part, n_rows, first_row, last_row) is returned, and
    written as JSON beside the files.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    target = f"{path}/{reference}_bank_payment_file" if reference else path
    ranged = titled(rows, columns).repartitionByRange(n, "batch_id", "row_number")
    dealt = saved(ranged.withColumn("part", F.format_string("%05d", F.spark_partition_id())), "file-parts")
    manifest = saved(dealt.groupBy("batch_id", "part").agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_number").alias("first_row"), F.max("row_number").alias("last_row")), "manifest")
    lines = dealt.withColumn("section", F.lit("1-lines")).repartition(n, "part").sortWithinPartitions("batch_id", "section", "part", "row_number").drop("row_number")
    lines.write.partitionBy("batch_id", "section", "part").options(**_CSV).csv(target)
    if totals is not None:
        last = totals.select("batch_id", *(F.col(c).alias(t) for c, t in columns.items()), F.lit("2-total").alias("section"), F.lit("00000").alias("part"))
        last.repartition(n, "batch_id").write.mode("append").partitionBy("batch_id", "section", "part").options(**_CSV).csv(target)
    manifest.orderBy("batch_id", "part").write.json(f"{target}/_manifest")
    return manifest


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_batches`` wrote: the columns of ``schema`` in the order of the file, then batch_id, section and part."""
    return spark.read.schema(f"{schema}, batch_id string, section string, part string").options(**_CSV).csv(path)
