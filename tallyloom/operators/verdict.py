"""Verdicts: does the paired invoice prove the requested amount?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import CENTS, amounts_equal, quantize

STATUSES = ("MATCHED", "AMOUNT_MISMATCH", "NO_INVOICE", "UNREADABLE")


def verify(paired: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Add status, invoice_amount and difference to rows with amount, invoice_seq and total_amount."""
    equal = amounts_equal(F.col("amount"), F.col("total_amount"), tolerance)
    status = F.when(F.col("invoice_seq").isNull(), "NO_INVOICE").when(F.col("total_amount").isNull(), "UNREADABLE").when(equal, "MATCHED").otherwise("AMOUNT_MISMATCH")
    seen = F.col("invoice_seq").isNotNull()
    return paired.withColumns({"status": status, "invoice_amount": F.when(seen, F.col("total_amount")), "difference": F.when(seen, (quantize(F.col("amount")) - quantize(F.col("total_amount"))).cast(CENTS))})


def verdict_note(status: str = "status") -> Column:
    """The sentence for a verdict; amounts in it are rounded half to even."""
    money = lambda c: F.bround(F.col(c), 2).cast(CENTS).cast("string")
    signed = F.concat(F.when(F.col("difference") >= 0, "+").otherwise(""), money("difference"))
    name = F.concat(F.lit("'"), F.col("source"), F.lit("'"))
    return (
        F.when(F.col(status) == "NO_INVOICE", "No invoice could be matched to this payment request; excluded from the bank file.")
        .when(F.col(status) == "UNREADABLE", F.concat(F.lit("Invoice "), name, F.lit(" was read via "), F.col("source_kind"), F.lit(" but no amount could be extracted; excluded from the bank file.")))
        .when(F.col(status) == "MATCHED", F.concat(F.lit("Verified against "), name, F.lit(".")))
        .otherwise(F.concat(F.lit("Requested "), money("amount"), F.lit(" but invoice "), name, F.lit(" shows "), money("total_amount"), F.lit(" (difference "), signed, F.lit("); excluded from the bank file.")))
    )


def results(requests: DataFrame, invoices: DataFrame, pairs: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """A verdict for each request: the request's columns, invoice_seq, source, source_kind, total_amount, status, invoice_amount, difference, confidence, reason, note."""
    side = invoices.select("batch_id", "invoice_seq", "source", "source_kind", "total_amount")
    joined = requests.join(pairs, ["batch_id", "row_number"]).join(side, ["batch_id", "invoice_seq"], "left")
    return verify(joined, tolerance).withColumn("note", verdict_note())


def included(found: DataFrame) -> DataFrame:
    return found.where("status = 'MATCHED'")


def excluded(found: DataFrame) -> DataFrame:
    return found.where("status <> 'MATCHED'")
