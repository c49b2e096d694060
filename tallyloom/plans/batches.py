"""Whole reconciliation of many batches at once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from ..operators import report
from ..operators.linkage import assigned_rows, attached, pairings, unmatched_invoices
from ..operators.verdict import results
from ..sources import sheets
from ..sources.sinks import AUDIT_COLUMNS, BANK_COLUMNS, write_batches
from ..storage import saved


class BatchReport:
    """Lazily evaluated tables of a run.

    What is paid and what stays over follows from the readable invoices alone; the unreadable ones are looked
    through only where a table tells why a request is held.
    """

    def __init__(self, read: sheets.Sheets, invoices: DataFrame, tolerance: str = "0.01"):
        self._read, self._invoices, self._tolerance = read, invoices, tolerance

    @cached_property
    def _assigned(self) -> tuple[DataFrame, DataFrame]:
        return assigned_rows(self._read.requests, self._invoices, self._tolerance)

    @cached_property
    def _payable(self) -> DataFrame:
        """Verdicts in which requests of unreadable invoices have none."""
        rows = results(self._read.requests, self._invoices, attached(*self._assigned), self._tolerance)
        return saved(rows.select("batch_id", "row_number", "request_no", "payee_name", "bank_code", "bank_account", "amount", "invoice_amount", "status"), "payable")

    @cached_property
    def results(self) -> DataFrame:
        return saved(results(self._read.requests, self._invoices, attached(*self._assigned, self._invoices), self._tolerance), "results")

    @cached_property
    def unmatched(self) -> DataFrame:
        return unmatched_invoices(self._invoices, self._assigned[0])

    @cached_property
    def _verdicts(self) -> DataFrame:
        return self.results if "results" in self.__dict__ else self._payable

    @property
    def bank_lines(self) -> DataFrame:
        return report.bank_lines(self._verdicts)

    @property
    def total_rows(self) -> DataFrame:
        return report.total_rows(self._verdicts)

    @property
    def totals(self) -> DataFrame:
        return report.batch_totals(self._verdicts)

    @property
    def audit(self) -> DataFrame:
        return report.audit_rows(self.results)

    @property
    def warnings(self) -> DataFrame:
        # a sheet without a usable request ends with its own warnings
        active = self._read.requests.select("batch_id").distinct()
        return report.batch_warnings(self._read.warnings, self._read.skipped, *(d.join(active, "batch_id", "left_semi") for d in (self._invoices, self.unmatched)))


def reconcile(requests: DataFrame, invoices: DataFrame, tolerance: str = "0.01", unreadable: bool = True) -> DataFrame:
    """Verdicts of requests (batch_id, row_number, ...) against invoices (batch_id, invoice_seq, ...).

    Without ``unreadable`` requests that only an unreadable invoice is like have no invoice: they are held either way.
    """
    return results(requests, invoices, pairings(requests, invoices, tolerance, unreadable), tolerance)


def verify_batches(raw_rows: DataFrame, invoices: DataFrame, tolerance: str = "0.01") -> BatchReport:
    """From sheet rows (file, row_number, cells) and invoice records to all reports.

    The file is the batch.  A batch without a usable request has no results.
    """
    return BatchReport(sheets.read_sheets(raw_rows), invoices, tolerance)


def write_reports(found: BatchReport, path: str, reference: str = "PAYMENT") -> tuple[DataFrame, DataFrame]:
    """The payment files with their TOTAL rows, and the audit files; returns their manifests."""
    paid = write_batches(found.bank_lines, BANK_COLUMNS, path, reference, found.total_rows)
    return paid, write_batches(found.audit, AUDIT_COLUMNS, f"{path}/{reference}_audit")
