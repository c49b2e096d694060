"""Request sheets: many files of rows, with headers in any of several wordings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import to_decimal
from ..storage import saved

# Header wordings of each field.
HEADER_CUES = {
    "request_no": ("payment request no", "payment request number", "request no", "request number", "請求編號", "付款請求編號", "申請編號", "序號"),
    "payee_name": ("payee name", "payee", "beneficiary name", "beneficiary", "收款人", "受款人", "供應商名稱", "供應商"),
    "bank_code": ("bank code", "bankcode", "銀行編號", "银行编号", "銀行代號", "銀行代碼"),
    "bank_account": ("bank account number", "bank account no", "bank account", "account number", "account no", "銀行賬戶號碼", "銀行帳號", "银行账号", "戶口號碼", "帳號", "賬號"),
    "particulars": ("particulars", "description", "details", "摘要", "項目", "用途"),
    "payment_amount": ("payment amount", "amount hkd", "amount", "payment amount hkd", "付款金額", "金額", "付款额"),
}
REQUIRED = ("payee_name", "bank_code", "bank_account", "payment_amount")
ESSENTIAL = ("payee_name", "payment_amount")
#: Rows at the top of a sheet in which its header is looked for.
HEADER_ROWS = 20

# Warnings of sheets.
NO_HEADER = "Could not find a header row containing at least a Payee Name and a Payment Amount column. Please check the summary layout."
NO_ROWS = "No usable payment request rows were found in the summary."


def read_raw_rows(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """file, row_number and cells of CSV files whose first column is the row number; all cells stay text."""
    schema = ", ".join(["row_number string", *(f"c{i} string" for i in range(columns))])
    rows = spark.read.schema(schema).csv(path)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col("row_number").cast("long"), F.array(*(f"c{i}" for i in range(columns))).alias("cells"))


def cell_text(cell: Column, numeric: bool = False) -> Column:
    """Trimmed text; empty for null.  Of numbers, a fraction of zeros goes."""
    text = F.coalesce(F.trim(cell), F.lit(""))
    return F.regexp_replace(text, r"\.0+$", "") if numeric else text


def normalise_header(cell: Column) -> Column:
    text = F.regexp_replace(F.lower(F.coalesce(cell, F.lit(""))), r"[（(].*?[)）]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "), r"\s+", " "))


def match_header_field(header: Column) -> Column:
    """Field of a normalised header: that of the longest wording it holds, null if it holds none."""
    cues = [(cue, field) for field, group in HEADER_CUES.items() for cue in group]
    chain = None
    for cue, field in sorted(cues, key=lambda c: -len(c[0])):
        hit = F.contains(header, F.lit(cue))
        chain = F.when(hit, field) if chain is None else chain.when(hit, field)
    return chain


def find_header_row(raw_rows: DataFrame) -> DataFrame:
    """file, header_row, columns (map of field to position) and captions (of field to wording): the first of the top rows that names payee and amount.

    A field belongs to its left-most cell.  Every file has a row; one without a header has
    nulls.  Fields are found within each row, so one aggregation by file is all that it takes.
    """
    field = F.transform("cells", lambda c: match_header_field(normalise_header(c)))
    rows = raw_rows.withColumn("fields", F.when(F.col("row_number") <= HEADER_ROWS, field))
    places = F.array(*(F.struct(F.lit(f).alias("field"), (F.array_position("fields", f) - 1).cast("int").alias("pos")) for f in HEADER_CUES))
    rows = rows.withColumn("found", F.filter(places, lambda p: p["pos"] >= 0))
    names = F.transform("found", lambda p: p["field"])
    good = F.array_contains(names, ESSENTIAL[0]) & F.array_contains(names, ESSENTIAL[1])
    columns = F.map_from_entries("found")
    captions = F.map_from_arrays(names, F.transform("found", lambda p: F.trim(F.get("cells", p["pos"]))))
    first = F.min_by(F.when(good, F.struct(F.col("row_number").alias("header_row"), columns.alias("columns"), captions.alias("captions"))), F.when(good, F.col("row_number")))
    return rows.groupBy("file").agg(first.alias("h")).select("file", "h.*")


def header_map(raw_rows: DataFrame) -> DataFrame:
    """file, field, caption of the header row."""
    return find_header_row(raw_rows).select("file", F.explode("captions").alias("field", "caption"))


def project_requests(raw_rows: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """Rows below the header, a text column for each field; missing cells are empty, a missing amount null."""
    rows = raw_rows.join(header or find_header_row(raw_rows), "file").where(F.col("row_number") > F.col("header_row"))
    cell = lambda field: F.try_element_at("cells", (F.try_element_at("columns", F.lit(field)) + 1).cast("int"))
    text = [cell_text(cell(f)).alias(f) for f in HEADER_CUES if f != "payment_amount"]
    return rows.select("file", "row_number", *text, to_decimal(cell("payment_amount")).alias("amount"))


def triage(projected: DataFrame) -> DataFrame:
    """Add ``route`` (usable, skipped or blank) and, for skipped rows, ``reason``."""
    no_payee, no_amount = F.col("payee_name") == "", F.col("amount").isNull()
    blank = no_payee & no_amount & (F.col("request_no") == "")
    where = F.concat(F.lit("Row "), F.col("row_number"))
    reason = F.when(blank, None).when(no_payee, F.concat(where, F.lit(": no payee name -- skipped.")))
    reason = reason.when(no_amount, F.concat(where, F.lit(": no readable payment amount for '"), F.col("payee_name"), F.lit("' -- skipped.")))
    return projected.withColumn("route", F.when(blank, "blank").when(no_payee | no_amount, "skipped").otherwise("usable")).withColumn("reason", reason)


def usable(triaged: DataFrame) -> DataFrame:
    """Usable rows as payment requests; the file is the batch, and a missing number is ROW and the row's."""
    number = F.when(F.col("request_no") == "", F.concat(F.lit("ROW"), F.col("row_number"))).otherwise(F.col("request_no"))
    return triaged.where("route = 'usable'").select(F.col("file").alias("batch_id"), "row_number", number.alias("request_no"), "payee_name", "bank_code", "bank_account", "particulars", "amount")


def requests(raw_rows: DataFrame) -> DataFrame:
    return usable(triage(project_requests(raw_rows)))


def skipped(raw_rows: DataFrame) -> DataFrame:
    return triage(project_requests(raw_rows)).where("route = 'skipped'").select("file", "row_number", "reason")


def warnings_of(header: DataFrame, triaged: DataFrame) -> DataFrame:
    """file, warning: no header, missing columns, or no usable rows."""
    headless = header.where("header_row IS NULL").select("file", F.lit(NO_HEADER).alias("warning"))
    lacking = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), F.map_keys("columns")))
    missing = header.where(F.size(lacking) > 0).select("file", F.concat(F.lit("Summary is missing expected column(s): "), F.array_join(lacking, ", "), F.lit(". Matching will be less reliable.")).alias("warning"))
    some = triaged.where("route = 'usable'").select("file").distinct()
    empty = header.where("header_row IS NOT NULL").join(some, "file", "left_anti").select("file", F.lit(NO_ROWS).alias("warning"))
    return headless.unionByName(missing).unionByName(empty)


def check_summary(raw_rows: DataFrame) -> DataFrame:
    header = saved(find_header_row(raw_rows), "headers")
    return warnings_of(header, triage(project_requests(raw_rows, header)))


@dataclass
class Sheets:
    """What the sheets hold: requests, skipped (batch_id, reason) and warnings (batch_id, warning)."""

    requests: DataFrame
    skipped: DataFrame
    warnings: DataFrame


def read_sheets(raw_rows: DataFrame) -> Sheets:
    """Headers and rows are each read once and saved."""
    header = saved(find_header_row(raw_rows), "headers")
    rows = saved(triage(project_requests(raw_rows, header)), "sheet-rows")
    return Sheets(usable(rows), rows.where("route = 'skipped'").select(F.col("file").alias("batch_id"), "reason"), warnings_of(header, rows).withColumnRenamed("file", "batch_id"))
