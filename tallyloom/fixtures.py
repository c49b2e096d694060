"""Tables of requests, invoices, sheets, texts and word boxes, derived from orders and customers.

The formulas use functions that Spark and other SQL engines share, so the same text serves
both: ``{orders}`` and ``{customer}`` stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TABLES = ("orders", "customer")

#: Variants: E (one name a customer, exact), L (also empty and misspelt names), U (a name an order).
BASE = """
SELECT o.o_orderpriority AS batch_id, o.o_orderkey AS row_number, o.o_orderkey % 20 AS k,
  'P' || lpad(CAST(o.o_orderkey AS STRING), 8, '0') AS request_no,
  upper(translate(substr(md5('payee' || CAST({key} AS STRING)), 1, 14), '0123456789abcdef', 'bcdfghjklmnprstv')) || ' Limited' AS payee_name,
  lpad(CAST(c.c_nationkey AS STRING), 3, '0') AS bank_code,
  lpad(CAST({key} AS STRING), 9, '0') AS bank_account,
  'Order ' || CAST(o.o_orderkey AS STRING) AS particulars,
  CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""
INVOICES = """
SELECT batch_id, row_number AS invoice_seq, 'INV' || CAST(row_number AS STRING) || '.pdf' AS source,
  CASE row_number % 3 WHEN 0 THEN 'TEXT_LAYER' WHEN 1 THEN 'OCR_LOCAL' ELSE 'OCR_VISION' END AS source_kind,
  CAST(CASE k WHEN 3 THEN NULL WHEN 1 THEN amount + 5000 WHEN 2 THEN amount + 0.01 ELSE amount END AS DECIMAL(18,2)) AS total_amount,
  {payee} AS payee_name, bank_code, CASE WHEN k = 4 THEN '' ELSE bank_account END AS bank_account
FROM base WHERE k <> 0
"""
_PAYEE = {"E": "payee_name", "U": "CASE k WHEN 5 THEN '' WHEN 6 THEN 'Q' || substr(payee_name, 2) ELSE payee_name END"}
_PAYEE["L"] = _PAYEE["U"]


def base_sql(variant: str = "E") -> str:
    return BASE.replace("{key}", "o.o_orderkey" if variant == "U" else "o.o_custkey")


def ledger_sql(variant: str = "E") -> str:
    """Common table expressions base, requests and invoices."""
    wanted = "SELECT batch_id, row_number, request_no, payee_name, bank_code, bank_account, particulars, amount FROM base"
    return f"base AS ({base_sql(variant)}), requests AS ({wanted}), invoices AS ({INVOICES.replace('{payee}', _PAYEE[variant])})"


def plain(sql: str) -> str:
    """SQL for an engine that knows the tables by their names."""
    for t in _TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES}


def ledger(spark: SparkSession, sf_dir: str, variant: str = "E") -> tuple[DataFrame, DataFrame]:
    """(requests, invoices)."""
    found = tables(spark, sf_dir)
    get = lambda name: spark.sql(f"WITH {ledger_sql(variant)} SELECT * FROM {name}", **found)
    return get("requests").withColumn("amount", F.col("amount").cast("decimal(18,6)")), get("invoices").withColumn("warnings", F.when(F.col("total_amount").isNull(), F.array(F.lit("No amount figure could be located on the document."))).otherwise(F.array().cast("array<string>")))


# Header wordings of the sheets, by batch.
HEADERS = {
    "1": ["Payment Request No", "Payee Name", "Bank Code", "Bank Account Number", "Particulars", "Payment Amount (HKD)"],
    "2": ["Request No", "Beneficiary", "Bank Code", "Account No", "Description", "Amount"],
    "3": ["付款請求編號", "收款人", "銀行編號", "銀行賬戶號碼", "摘要", "付款金額"],
    "4": ["Payment  Request No.", " PAYEE（name）Payee", "Bankcode", "bank account no", "Details", "amount(HKD)"],
    "5": ["Payee Name", "Payment Amount"],
}


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, row_number, cells: a sheet for each batch, with a title, a blank row, a header in row 3, and defective rows by key."""
    base = spark.sql(base_sql(), **tables(spark, sf_dir)).withColumn("file", F.substring("batch_id", 1, 1))
    amount = F.when(F.col("row_number") % 43 == 0, "n/a").when(F.col("row_number") % 7 == 0, F.concat(F.lit("HKD "), F.format_number("amount", 2))).otherwise(F.col("amount").cast("string"))
    payee = F.when(F.col("row_number") % 41 == 0, F.lit(None)).otherwise(F.col("payee_name"))
    full = F.array("request_no", payee, "bank_code", "bank_account", "particulars", amount)
    cells = F.when(F.col("row_number") % 50 == 0, F.transform(full, lambda c: F.lit(None).cast("string"))).when(F.col("file") == "5", F.array(F.when(F.col("row_number") % 50 != 0, payee), F.when(F.col("row_number") % 50 != 0, amount))).otherwise(full)
    data = base.select("file", (F.col("row_number") + 10).alias("row_number"), cells.alias("cells"))
    top = [(f, 1, ["Payment summary", None]) for f in HEADERS] + [(f, 2, [None, None]) for f in HEADERS] + [(f, 3, h) for f, h in HEADERS.items()]
    return data.unionByName(spark.createDataFrame(top, "file string, row_number long, cells array<string>"))


def customer_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, row_number, cells: a sheet for each customer, without a header, without a payee in any row, with two columns, or whole, by key."""
    base = spark.sql(base_sql().replace("SELECT", "SELECT o.o_custkey AS owner,", 1), **tables(spark, sf_dir))
    kind, file = F.col("owner") % 4, F.concat(F.lit("C"), "owner")
    amount = F.col("amount").cast("string")
    full = F.array("request_no", F.when(kind != 1, F.col("payee_name")), "bank_code", "bank_account", "particulars", amount)
    data = base.select(file.alias("file"), (F.col("row_number") + 10).alias("row_number"), F.when(kind == 2, F.array("payee_name", amount)).otherwise(full).alias("cells"))
    whole, thin = (F.array(*map(F.lit, HEADERS[k])) for k in ("2", "5"))
    top = base.where(kind != 0).select("owner").distinct().select(file.alias("file"), F.lit(4).cast("long").alias("row_number"), F.when(kind == 2, thin).otherwise(whole).alias("cells"))
    return data.unionByName(top)


#: Requests that the sheets hold, for the other engine: thin is the batch with two columns.
SHEET_REQUESTS = """
SELECT substr(batch_id, 1, 1) AS file, row_number + 10 AS row_number, substr(batch_id, 1, 1) = '5' AS thin, row_number % 41 = 0 AS no_payee, row_number % 43 = 0 AS no_amount, row_number % 50 = 0 AS blank,
  request_no, payee_name, bank_code, bank_account, particulars, amount
FROM base
"""


def invoice_texts(spark: SparkSession, sf_dir: str, uneven: bool = False) -> DataFrame:
    """doc_id, text: invoices in three layouts; in every seventh the zeros of the amount are read as letters.

    uneven: as the invoices of the ledger go, some are missing, some ask for more, and some have no readable amount.
    """
    base, k = spark.sql(base_sql(), **tables(spark, sf_dir)), F.col("k")
    if uneven:
        amount = F.when(k == 1, F.col("amount") + 5000).when(k == 2, F.col("amount") + F.lit("0.01").cast("decimal(18,2)")).when(k != 3, F.col("amount"))
        base = base.where(k != 0).withColumn("amount", amount.cast("decimal(18,2)"))
    money = F.coalesce(F.format_number("amount", 2), F.lit("illegible"))
    money = F.when(F.col("row_number") % 7 == 0, F.replace(money, F.lit("0"), F.lit("o"))).otherwise(money)
    number = F.concat(F.lit("INV"), F.lpad(F.col("row_number").cast("string"), 8, "0"))
    row = lambda *cells: F.concat_ws("  ", *(F.lit(c) if isinstance(c, str) else c for c in cells))
    payee, code, account = F.col("payee_name"), F.col("bank_code"), F.col("bank_account")
    table = [F.lit("INVOICE"), row("Invoice Number", "Invoice Date"), row(number, "2026/09/08"), row("Payee Name", "Bank Code", "Bank Account Number"), row(payee, code, account), F.concat(F.lit("Total Amount: HKD"), money)]
    beside = [F.lit("發票"), row("發票編號", number), row("收款人", payee), row("銀行編號", code), row("銀行賬戶號碼", account), row("總計", money)]
    below = [F.lit("Invoice"), F.lit("Payee Name"), payee, F.lit("Bank Code"), code, F.lit("Bank Account Number"), account, F.lit("TOTAL"), money]
    join = lambda lines: F.concat_ws("\n", *lines)
    kind = F.col("row_number") % 3
    return base.select(F.col("row_number").alias("doc_id"), F.when(kind == 0, join(table)).when(kind == 1, join(beside)).otherwise(join(below)).alias("text"))


#: Lines of the same invoices for the other engine.
TEXT_LINES = """
texts AS (
  SELECT row_number AS doc_id, payee_name, bank_code, bank_account, amount, 'INV' || lpad(CAST(row_number AS STRING), 8, '0') AS invoice_no,
    CASE WHEN row_number % 7 = 0 THEN replace(format('{:,.2f}', amount), '0', 'o') ELSE format('{:,.2f}', amount) END AS money
  FROM base
), lined AS (
  SELECT *, CASE doc_id % 3
    WHEN 0 THEN ['INVOICE', 'Invoice Number  Invoice Date', invoice_no || '  2026/09/08', 'Payee Name  Bank Code  Bank Account Number', payee_name || '  ' || bank_code || '  ' || bank_account, 'Total Amount: HKD' || money]
    WHEN 1 THEN ['發票', '發票編號  ' || invoice_no, '收款人  ' || payee_name, '銀行編號  ' || bank_code, '銀行賬戶號碼  ' || bank_account, '總計  ' || money]
    ELSE ['Invoice', 'Payee Name', payee_name, 'Bank Code', bank_code, 'Bank Account Number', bank_account, 'TOTAL', money] END AS lines
  FROM texts
)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the invoice texts on a grid, with jitter by key."""
    lines = invoice_texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    parts = lines.withColumn("parts", F.split("line", " "))
    before = lambda i: F.slice(F.col("parts"), F.lit(1), i)
    left = lambda i: 10 * (F.aggregate(before(i), F.lit(0), lambda a, x: a + F.length(x) + 1) + 5 * F.size(F.filter(before(i), lambda x: x == "")))
    words = F.filter(F.transform("parts", lambda x, i: F.struct(x.alias("text"), left(i).alias("left"))), lambda w: w["text"] != "")
    placed = parts.select("doc_id", "line_no", F.explode(words).alias("w"))
    jitter = F.pmod(F.col("doc_id") * 31 + F.col("line_no") * 17 + F.col("w.left"), F.lit(7)) - 3
    top = (F.col("line_no") * 40 + jitter).cast("double")
    return placed.select("doc_id", F.lit(1).alias("page_no"), top.alias("top"), (top + 20).alias("bottom"), F.col("w.left").cast("double").alias("left"), (F.col("w.left") + 10 * F.length("w.text")).cast("double").alias("right"), F.col("w.text").alias("text"))
