"""Reports of verified batches: payment lines, totals, reasons, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import CENTS, format_amount, format_amount_display, quantize
from ..functions.text import bank_id
from .verdict import STATUSES, excluded, included

# What statuses and routes are called in reports.
STATUS_LABELS = {"MATCHED": "Matched", "AMOUNT_MISMATCH": "Amount mismatch", "NO_INVOICE": "No invoice", "UNREADABLE": "Unreadable invoice"}
ROUTE_LABELS = {"TEXT_LAYER": "PDF text layer", "OCR_LOCAL": "Offline OCR", "OCR_VISION": "Cloud vision OCR", "NONE": "-"}


def _label(column: str, labels: dict[str, str]) -> Column:
    chain = F.lit(None).cast("string")
    for key, label in reversed(labels.items()):
        chain = F.when(F.col(column) == key, label).otherwise(chain)
    return chain


def payable() -> Column:
    """The amount that is paid: the invoice's, else the requested one, in cents."""
    return quantize(F.coalesce("invoice_amount", F.col("amount").cast(CENTS)))


def bank_lines(found: DataFrame) -> DataFrame:
    """batch_id, row_number, request_no, payee_name, bank_id, amount of the verified payments."""
    return included(found).select("batch_id", "row_number", "request_no", "payee_name", bank_id(F.col("bank_code"), F.col("bank_account")).alias("bank_id"), payable().alias("amount"))


def total_rows(found: DataFrame) -> DataFrame:
    """A TOTAL row (row_number null) for each batch; 0.00 where nothing is paid."""
    sums = found.groupBy("batch_id").agg(F.sum(F.when(F.col("status") == "MATCHED", payable())).alias("amount"))
    empty = F.lit(None).cast("string")
    return sums.select("batch_id", F.lit(None).cast("long").alias("row_number"), empty.alias("request_no"), empty.alias("payee_name"), F.lit("TOTAL").alias("bank_id"), F.coalesce("amount", F.lit(0)).cast("decimal(28,2)").alias("amount"))


def bank_total_row(found: DataFrame) -> DataFrame:
    """Payment lines and, for each batch, its TOTAL row."""
    return bank_lines(found).withColumn("amount", F.col("amount").cast("decimal(28,2)")).unionByName(total_rows(found))


def batch_totals(found: DataFrame) -> DataFrame:
    """batch_id, n_requests, n_included, n_excluded, total_payable."""
    ok = F.col("status") == "MATCHED"
    return found.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_requests"), F.count_if(ok).alias("n_included"), F.count_if(~ok).alias("n_excluded"), F.coalesce(F.sum(F.when(ok, payable())), F.lit(0)).cast("decimal(28,2)").alias("total_payable"))


def counts_by_status(found: DataFrame) -> DataFrame:
    """batch_id, status, n: all four statuses of each batch, with zeros."""
    counts = found.groupBy("batch_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    return counts.select("batch_id", F.explode(F.array(*(F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in STATUSES))).alias("c")).select("batch_id", "c.status", "c.n")


def exclusions_by_reason(found: DataFrame) -> DataFrame:
    """batch_id, reason, n of what was held."""
    return excluded(found).groupBy("batch_id", _label("status", STATUS_LABELS).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def audit_rows(found: DataFrame) -> DataFrame:
    """Every request with its verdict; empty text where there is no invoice."""
    basis = F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(" Match basis: "), F.col("reason"), F.lit("."))).otherwise("")
    return found.select(
        "batch_id", "row_number", "request_no", "payee_name",
        bank_id(F.col("bank_code"), F.col("bank_account")).alias("bank_id"),
        quantize(F.col("amount")).alias("requested"),
        F.coalesce("source", F.lit("")).alias("invoice_file"),
        quantize(F.col("invoice_amount")).alias("invoice_amount"),
        quantize(F.col("difference")).alias("difference"),
        _label("status", STATUS_LABELS).alias("status_label"),
        F.coalesce("source_kind", F.lit("")).alias("read_via"),
        F.bround("confidence", 2).alias("confidence"),
        F.trim(F.concat("note", basis)).alias("remarks"),
    )


def screen_rows(found: DataFrame) -> DataFrame:
    """Rows for a screen: badge, amounts with commas, signed difference, route."""
    signed = F.concat(F.when(F.col("difference") >= 0, "+").otherwise(""), F.format_number("difference", 2))
    return found.select(
        "batch_id", "row_number", F.when(F.col("status") == "MATCHED", "PASS").otherwise("HOLD").alias("badge"), "request_no", "payee_name", format_amount_display(F.col("amount")).alias("requested"), F.coalesce("source", F.lit("-")).alias("invoice_file"),
        format_amount_display(F.col("invoice_amount")).alias("invoice_amount"), F.coalesce(signed, F.lit("-")).alias("difference"), "status", F.coalesce(_label("source_kind", ROUTE_LABELS), F.lit("-")).alias("read_via"), F.col("note").alias("remark"),
    )


def results_json(found: DataFrame) -> DataFrame:
    """batch_id, row_number and a JSON object of each result."""
    fields = F.struct(
        "request_no", F.col("payee_name").alias("payee"), format_amount(F.col("amount")).alias("requested"), F.col("source").alias("invoice"), format_amount(F.col("invoice_amount")).alias("invoice_amount"), "status", F.col("source_kind").alias("source"), F.col("note").alias("remark"),
    )
    return found.select("batch_id", "row_number", F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


def batch_warnings(sheet_warnings: DataFrame, skipped: DataFrame, invoices: DataFrame, unmatched: DataFrame) -> DataFrame:
    """batch_id, warning: of the sheet, of skipped rows, of each invoice, and of the invoices that support nothing.

    sheet_warnings has batch_id, warning; skipped batch_id, reason; invoices batch_id, source, warnings.
    """
    own = invoices.select("batch_id", F.explode(F.transform("warnings", lambda w: F.concat_ws(": ", F.col("source"), w))).alias("warning"))
    names = unmatched.groupBy("batch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("total_amount").isNull().alias("late"), "invoice_seq", "source"))), lambda x: x["source"]), ", ").alias("names"))
    idle = names.select("batch_id", F.concat(F.lit("Invoice(s) provided but not matched to any payment request: "), F.col("names")).alias("warning"))
    return sheet_warnings.select("batch_id", "warning").unionByName(skipped.select("batch_id", F.col("reason").alias("warning"))).unionByName(own).unionByName(idle)
