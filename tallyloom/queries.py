"""Registered queries of the reconciliation library, with SQL of the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import money as M
from .functions import text as N
from .operators import boxes as B
from .operators import fields as E
from .operators import linkage as P
from .operators import report as A
from .operators import verdict as V
from .plans.batches import reconcile, verify_batches
from .sources import documents as D
from .sources import sheets as R
from .sources import sinks as S
from .storage import new_folder, saved

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = X.plain(sql)
        return f

    return keep


def _ledger_sql(rest: str, variant: str = "E") -> str:
    return f"WITH {X.ledger_sql(variant)} {rest}"


# ---- the exact ledger in SQL: k-th request of a name with its k-th readable invoice
_RESULTS = f"""WITH {X.ledger_sql()},
r AS (SELECT *, row_number() OVER (PARTITION BY batch_id, payee_name ORDER BY row_number) AS nth FROM requests),
i AS (SELECT *, row_number() OVER (PARTITION BY batch_id, payee_name ORDER BY invoice_seq) AS nth FROM invoices WHERE total_amount IS NOT NULL),
late AS (SELECT batch_id, payee_name, min(invoice_seq) AS invoice_seq FROM invoices WHERE total_amount IS NULL GROUP BY 1, 2),
pairs AS (
  SELECT r.batch_id, r.row_number, coalesce(i.invoice_seq, late.invoice_seq) AS invoice_seq, CASE WHEN i.invoice_seq IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS confidence,
    CASE WHEN i.invoice_seq IS NOT NULL THEN 'name similarity 1.00' || CASE WHEN r.bank_account = i.bank_account AND r.bank_code = i.bank_code THEN ', bank account matches' ELSE '' END
        || CASE WHEN abs(r.amount - i.total_amount) <= 0.01 THEN ', invoice total agrees with the requested amount' ELSE '' END
      WHEN late.invoice_seq IS NOT NULL THEN '{P.UNREADABLE}' ELSE '{P.UNMATCHED}' END AS reason
  FROM r LEFT JOIN i ON r.batch_id = i.batch_id AND r.payee_name = i.payee_name AND r.nth = i.nth
  LEFT JOIN late ON r.batch_id = late.batch_id AND r.payee_name = late.payee_name AND i.invoice_seq IS NULL
),
judged AS (
  SELECT r.*, p.invoice_seq, p.confidence, p.reason, v.source, v.source_kind, v.total_amount, v.total_amount AS invoice_amount, r.amount - v.total_amount AS difference,
    CASE WHEN p.invoice_seq IS NULL THEN 'NO_INVOICE' WHEN v.total_amount IS NULL THEN 'UNREADABLE' WHEN abs(r.amount - v.total_amount) <= 0.01 THEN 'MATCHED' ELSE 'AMOUNT_MISMATCH' END AS status
  FROM requests r JOIN pairs p ON r.batch_id = p.batch_id AND r.row_number = p.row_number LEFT JOIN invoices v ON p.batch_id = v.batch_id AND p.invoice_seq = v.invoice_seq
),
results AS (
  SELECT *, CASE status WHEN 'NO_INVOICE' THEN 'No invoice could be matched to this payment request; excluded from the bank file.'
    WHEN 'UNREADABLE' THEN 'Invoice ''' || source || ''' was read via ' || source_kind || ' but no amount could be extracted; excluded from the bank file.'
    WHEN 'MATCHED' THEN 'Verified against ''' || source || '''.'
    ELSE 'Requested ' || CAST(amount AS STRING) || ' but invoice ''' || source || ''' shows ' || CAST(total_amount AS STRING) || ' (difference ' || CASE WHEN difference >= 0 THEN '+' ELSE '' END || CAST(difference AS STRING) || '); excluded from the bank file.' END AS note
  FROM judged
)
"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile(*X.ledger(spark, sf_dir))


def _payable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for what is paid: requests of unreadable invoices are held either way, and have none here."""
    return reconcile(*X.ledger(spark, sf_dir), unreadable=False)


def _payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, saved for more than one use."""
    return saved(_payable(spark, sf_dir).select("batch_id", "row_number", "request_no", "payee_name", "bank_code", "bank_account", "amount", "invoice_amount", "status"), "payments")


def _pairs(spark: SparkSession, sf_dir: str, variant: str = "E", unreadable: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    requests, invoices = X.ledger(spark, sf_dir, variant)
    return requests, invoices, P.pairings(requests, invoices, unreadable=unreadable)


# ---- 2.1 sources and sinks
_HEADER_ROWS = "(VALUES " + ", ".join(f"('{f}', {i}, '{h}')" for f, hs in X.HEADERS.items() for i, h in enumerate(hs)) + ") AS h(file, pos, caption)"


#: All cells of the sheets, for the other engine.
_RAW_CELLS = f"""WITH base AS ({X.base_sql()}), named AS (SELECT *, substr(batch_id, 1, 1) AS file, CASE WHEN row_number % 41 <> 0 THEN payee_name END AS payee,
  CASE WHEN row_number % 43 = 0 THEN 'n/a' WHEN row_number % 7 = 0 THEN 'HKD ' || format('{{:,.2f}}', amount) ELSE CAST(amount AS STRING) END AS shown FROM base),
listed AS (SELECT file, row_number + 10 AS row_number, CASE WHEN file = '5' THEN [payee, shown] ELSE [request_no, payee, bank_code, bank_account, particulars, shown] END AS held, (row_number % 50) = 0 AS blank FROM named),
raw_rows AS (SELECT file, row_number, CASE WHEN blank THEN list_transform(range(6), lambda c: CAST(NULL AS STRING)) ELSE held END AS cells FROM listed
  UNION ALL SELECT file, n, CASE n WHEN 1 THEN ['Payment summary', NULL] WHEN 2 THEN [CAST(NULL AS STRING), NULL] ELSE captions END FROM (SELECT file, list(caption ORDER BY pos) AS captions FROM {_HEADER_ROWS} GROUP BY file), (VALUES (1), (2), (3)) AS t(n)),
cells AS (SELECT file, row_number, CAST(generate_subscripts(cells, 1) - 1 AS INTEGER) AS pos, unnest(cells) AS caption FROM raw_rows) """


@query("i1_read_raw_rows", _RAW_CELLS + "SELECT row_number, array_to_string(list_transform([1, 2, 3, 4, 5, 6], lambda i: trim(coalesce(cells[i], ''))), '|') AS line FROM raw_rows")
def _(spark, sf_dir):
    """Sheets written as CSV and read back."""
    path = new_folder(spark, "sheets")
    rows = X.raw_rows(spark, sf_dir)
    rows.select("row_number", *(F.try_element_at("cells", F.lit(i + 1)).alias(f"c{i}") for i in range(6)), F.col("file").alias("sheet")).write.partitionBy("sheet").csv(path)
    return R.read_raw_rows(spark, f"{path}/*", 6).select("row_number", F.array_join(F.transform("cells", lambda c: R.cell_text(c)), "|").alias("line"))


@query("i2_read_documents", "SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def _(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return D.join_pages(pages, "conv_id", "turn").select(F.col("conv_id").alias("doc_id"), "text")


_BANK_SQL = """SELECT batch_id, row_number, request_no AS "Payment Request No", payee_name AS "Payee Name", bank_code || '-' || bank_account AS "Bank Code and Account Number", invoice_amount AS "Payment Amount (HKD)" FROM results WHERE status = 'MATCHED'"""
_AUDIT_SQL = """SELECT batch_id, row_number, {request_no}, {payee_name}, bank_code || '-' || bank_account AS {bank_id}, amount AS {requested}, coalesce(source, '') AS {invoice_file}, invoice_amount AS {invoice_amount}, difference AS {difference},
CASE status WHEN 'MATCHED' THEN 'Matched' WHEN 'AMOUNT_MISMATCH' THEN 'Amount mismatch' WHEN 'NO_INVOICE' THEN 'No invoice' ELSE 'Unreadable invoice' END AS {status_label}, coalesce(source_kind, '') AS {read_via}, confidence AS {confidence},
note || ' Match basis: ' || reason || '.' AS {remarks} FROM results"""
_titled = {c: f'"{t}"' for c, t in S.AUDIT_COLUMNS.items()}


@query(
    "i3_write_bank_lines",
    _RESULTS + """SELECT batch_id, '1-lines' AS section, request_no, payee_name, bank_code || '-' || bank_account AS bank_id, CAST(invoice_amount AS STRING) AS amount FROM results WHERE status = 'MATCHED'
UNION ALL SELECT batch_id, '2-total', NULL, NULL, 'TOTAL', CAST(CAST(coalesce(sum(CASE WHEN status = 'MATCHED' THEN invoice_amount END), 0) AS DECIMAL(28,2)) AS STRING) FROM results GROUP BY batch_id""",
)
def _(spark, sf_dir):
    """Payment files with their TOTAL rows, written and read back."""
    path, found = new_folder(spark, "bank"), _payments(spark, sf_dir)
    S.write_batches(A.bank_lines(found), S.BANK_COLUMNS, path, "PAYMENT", A.total_rows(found))
    return S.read_batches(spark, f"{path}/PAYMENT_bank_payment_file", "request_no string, payee_name string, bank_id string, amount string").drop("part")


@query(
    "i3_manifest",
    _RESULTS + "SELECT batch_id, CAST(count(*) AS BIGINT) AS n_rows, min(row_number) AS first_row, max(row_number) AS last_row, CAST(1 AS BOOLEAN) AS in_order FROM results WHERE status = 'MATCHED' GROUP BY batch_id",
)
def _(spark, sf_dir):
    """The parts of each payment file; whether each begins behind the one before it."""
    path, found = new_folder(spark, "bank"), _payments(spark, sf_dir)
    parts = S.write_batches(A.bank_lines(found), S.BANK_COLUMNS, path, "PAYMENT")
    before = F.lag("last_row").over(W.partitionBy("batch_id").orderBy("part"))  # a row a part
    parts = parts.withColumn("fine", F.coalesce(F.col("first_row") > before, F.lit(True)))
    return parts.groupBy("batch_id").agg(F.sum("n_rows").alias("n_rows"), F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"), F.min("fine").alias("in_order"))


@query("i4_write_audit", _RESULTS + "SELECT * EXCLUDE (row_number) FROM (" + _AUDIT_SQL.format(**{**_titled, "request_no": 'request_no AS "Payment Request No"', "payee_name": 'payee_name AS "Payee Name"'}) + ")")
def _(spark, sf_dir):
    """Audit files, written and read back."""
    path, rows = new_folder(spark, "audit"), saved(A.audit_rows(_found(spark, sf_dir)), "audit-rows")
    S.write_batches(rows, S.AUDIT_COLUMNS, path)
    schema = ", ".join(f"`{title}` {rows.schema[c].dataType.simpleString()}" for c, title in S.AUDIT_COLUMNS.items())
    return S.read_batches(spark, path, schema).drop("section", "part").na.fill("")  # CSV has no other empty text


@query(
    "i5_results_json",
    _RESULTS
    + """SELECT batch_id, row_number, CAST(json_object('request_no', request_no, 'payee', payee_name, 'requested', CAST(amount AS STRING), 'invoice', source, 'invoice_amount', coalesce(CAST(invoice_amount AS STRING), ''), 'status', status, 'source', source_kind, 'remark', note) AS STRING) AS json FROM results""",
)
def _(spark, sf_dir):
    return A.results_json(_found(spark, sf_dir))


# ---- 2.2 request sheets
_SHEET = f"WITH base AS ({X.base_sql()}), sheet AS ({X.SHEET_REQUESTS}), good AS (SELECT * FROM sheet WHERE NOT blank AND NOT no_payee AND NOT no_amount)"
_FIELDS = ["request_no", "payee_name", "bank_code", "bank_account", "particulars", "payment_amount"]
_FIELD_OF = "(VALUES " + ", ".join(f"('{f}', {i}, '{x}')" for f, hs in X.HEADERS.items() for i, x in enumerate(_FIELDS if len(hs) == 6 else ["payee_name", "payment_amount"])) + ") AS g(file, pos, field)"


@query("r1_normalise_header", _RAW_CELLS + "SELECT file, row_number, pos, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(caption, '')), '[（(].*?[)）]', ' ', 'g'), '[^\\p{L}\\p{N}_]+', ' ', 'g'), '\\s+', ' ', 'g')) AS header FROM cells")
def _(spark, sf_dir):
    cells = X.raw_rows(spark, sf_dir).select("file", "row_number", F.posexplode("cells").alias("pos", "caption"))
    return cells.select("file", "row_number", "pos", R.normalise_header(F.col("caption")).alias("header"))


@query("r2_match_header_field", _RAW_CELLS + f"SELECT c.file, row_number, c.pos, field FROM cells c LEFT JOIN {_FIELD_OF} ON row_number = 3 AND c.file = g.file AND c.pos = g.pos")
def _(spark, sf_dir):
    """Of all cells; those of other rows hold no wording of a header."""
    cells = X.raw_rows(spark, sf_dir).select("file", "row_number", F.posexplode("cells").alias("pos", "caption"))
    return cells.select("file", "row_number", "pos", R.match_header_field(R.normalise_header(F.col("caption"))).alias("field"))


@query("r3_find_header_row", f"SELECT file, CAST(3 AS BIGINT) AS header_row, field, pos FROM {_FIELD_OF}")
def _(spark, sf_dir):
    return R.find_header_row(X.raw_rows(spark, sf_dir)).select("file", "header_row", F.explode("columns").alias("field", "pos"))


_PROJECTED = _SHEET + """SELECT file, row_number, CASE WHEN blank OR thin THEN '' ELSE request_no END AS request_no, CASE WHEN blank OR no_payee THEN '' ELSE payee_name END AS payee_name,
CASE WHEN blank OR thin THEN '' ELSE bank_code END AS bank_code, CASE WHEN blank OR thin THEN '' ELSE bank_account END AS bank_account, CASE WHEN blank OR thin THEN '' ELSE particulars END AS particulars, CASE WHEN blank OR no_amount THEN NULL ELSE amount END AS amount"""


@query("r4_project_requests", _PROJECTED + " FROM sheet")
def _(spark, sf_dir):
    return R.project_requests(X.raw_rows(spark, sf_dir)).withColumn("amount", M.quantize(F.col("amount")))


@query("r5_cell_text", "SELECT o_orderkey AS id, CAST(o_orderkey AS STRING) AS whole, trim(o_orderpriority) AS text FROM orders")
def _(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), R.cell_text(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")), numeric=True).alias("whole"), R.cell_text(F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))).alias("text"))


@query("r6_to_decimal", f"WITH base AS ({X.base_sql()}) SELECT row_number AS id, amount AS value FROM base")
def _(spark, sf_dir):
    base = spark.sql(X.base_sql(), **X.tables(spark, sf_dir))
    text = F.when(F.col("row_number") % 3 == 0, F.concat(F.lit("HKD "), F.format_number("amount", 2))).when(F.col("row_number") % 3 == 1, F.concat(F.lit(" $ "), F.col("amount").cast("string"))).otherwise(F.col("amount").cast("string"))
    return base.select(F.col("row_number").alias("id"), M.to_decimal(text).cast(M.CENTS).alias("value"))


@query(
    "r7_triage_rows",
    _SHEET + """SELECT file, row_number, CASE WHEN blank OR (thin AND no_payee AND no_amount) THEN 'blank' WHEN no_payee OR no_amount THEN 'skipped' ELSE 'usable' END AS route,
CASE WHEN blank OR (thin AND no_payee AND no_amount) THEN NULL WHEN no_payee THEN 'Row ' || CAST(row_number AS STRING) || ': no payee name -- skipped.' WHEN no_amount THEN 'Row ' || CAST(row_number AS STRING) || ': no readable payment amount for ''' || payee_name || ''' -- skipped.' END AS reason FROM sheet""",
)
def _(spark, sf_dir):
    return R.triage(R.project_requests(X.raw_rows(spark, sf_dir))).select("file", "row_number", "route", "reason")


@query(
    "r8_check_summary",
    f"""SELECT DISTINCT 'C' || CAST(o_custkey AS STRING) AS file, CASE o_custkey % 4 WHEN 0 THEN '{R.NO_HEADER}' WHEN 1 THEN '{R.NO_ROWS}'
  ELSE 'Summary is missing expected column(s): bank_account, bank_code. Matching will be less reliable.' END AS warning FROM orders WHERE o_custkey % 4 < 3 AND o_custkey IN (SELECT c_custkey FROM customer)""",
)
def _(spark, sf_dir):
    """A sheet for each customer: without a header, without a usable row, without columns, or whole."""
    return R.check_summary(X.customer_sheets(spark, sf_dir))


@query("r9_header_map", f"SELECT h.file, field, trim(caption) AS caption FROM {_HEADER_ROWS} JOIN {_FIELD_OF} ON h.file = g.file AND h.pos = g.pos")
def _(spark, sf_dir):
    return R.header_map(X.raw_rows(spark, sf_dir))


# ---- 2.3 text acquisition
_SOLID = "regexp_replace(coalesce(text, ''), '[\\s\\x{85}\\p{Z}\\x1c-\\x1f]+', '', 'g')"


@query("t1_is_text_layer", f"SELECT doc_id, length({_SOLID}) >= 60 AND len(list_distinct(string_split({_SOLID}, ''))) > 8 AS enough FROM documents")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", N.is_text_layer(F.col("text")).alias("enough"))


@query(
    "t2_choose_text",
    """SELECT o_orderkey AS id, ['TEXT_LAYER', 'OCR_LOCAL', 'OCR_VISION', 'NONE', 'OCR_LOCAL', 'NONE'][k + 1] AS source_kind, CASE WHEN k IN (0, 1) THEN 0 ELSE 1 END AS n_warnings, CASE WHEN k IN (3, 5) THEN 0 ELSE 1 END AS filled
FROM (SELECT o_orderkey, o_orderkey % 6 AS k FROM orders)""",
)
def _(spark, sf_dir):
    """A text layer, OCR, vision, nothing, a text layer passed over for OCR, and vision that is refused."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("k", F.col("o_orderkey") % 6)
    k, long = F.col("k"), F.lit("The quick brown fox jumps over the lazy dog while seventy other animals look on")
    chosen = N.choose_text(F.when(k.isin(0, 4), long).otherwise("scan"), F.when(k.isin(1, 4), "ocr").otherwise(" "), F.when(k.isin(2, 5), "seen"), force_ocr=k == 4, allow_vision=k != 5)
    return o.select(F.col("o_orderkey").alias("id"), chosen.alias("c")).select("id", "c.source_kind", F.size("c.warnings").alias("n_warnings"), (F.length("c.text") > 0).cast("int").alias("filled"))


_LINES = f"WITH base AS ({X.base_sql()}), {X.TEXT_LINES}"


@query("t3_boxes_to_lines", _LINES + " SELECT doc_id, 1 AS page_no, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS line_no, unnest(lines) AS line FROM lined")
def _(spark, sf_dir):
    return B.boxes_to_lines(X.boxes(spark, sf_dir))


# ---- 2.4 money and text
@query("m1_repair_ocr_numbers", f"WITH base AS ({X.base_sql()}) SELECT row_number AS id, format('{{:,.2f}}', amount) AS fixed FROM base")
def _(spark, sf_dir):
    base = spark.sql(X.base_sql(), **X.tables(spark, sf_dir))
    money = F.format_number("amount", 2)
    misread = F.when(F.col("row_number") % 2 == 0, F.replace(money, F.lit("0"), F.lit("o"))).otherwise(F.replace(money, F.lit(","), F.lit(".")))
    return base.select(F.col("row_number").alias("id"), M.repair_ocr_numbers(misread).alias("fixed"))


@query("m2_find_amounts", f"WITH base AS ({X.base_sql()}) SELECT row_number AS doc_id, 1 AS n, amount, row_number % 3 = 0 AS has_currency FROM base")
def _(spark, sf_dir):
    found = M.find_amounts(F.col("text"))
    return X.invoice_texts(spark, sf_dir).select("doc_id", found.alias("f")).select("doc_id", F.size("f").alias("n"), F.element_at("f", 1)["amount"].alias("amount"), F.element_at("f", 1)["has_currency"].alias("has_currency"))


@query(
    "m3_classify_amount",
    """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) WHEN 1 THEN NULL WHEN 2 THEN CAST(o_orderkey AS DECIMAL(18,2)) WHEN 3 THEN NULL ELSE CAST(1230 AS DECIMAL(18,2)) END AS amount FROM orders""",
)
def _(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("k", F.col("o_orderkey") % 5)
    key = F.col("o_orderkey").cast("string")
    number = F.when(F.col("k") == 0, F.col("o_totalprice").cast(M.CENTS).cast("string")).when(F.col("k").isin(1, 2), key).when(F.col("k") == 3, F.concat(key, F.lit(".123"))).otherwise("1,230")
    return o.select(F.col("o_orderkey").alias("id"), M.classify_amount(number, F.when(F.col("k") == 2, "HKD").otherwise("")).alias("amount"))


@query("m4_amounts_table", f"WITH base AS ({X.base_sql()}) SELECT row_number AS doc_id, 0 AS pos, amount FROM base")
def _(spark, sf_dir):
    return X.invoice_texts(spark, sf_dir).select("doc_id", F.posexplode(M.amount_values(F.col("text"))).alias("pos", "amount"))


@query("m5_extract_total", f"WITH base AS ({X.base_sql()}) SELECT row_number AS doc_id, amount AS total_amount FROM base")
def _(spark, sf_dir):
    return X.invoice_texts(spark, sf_dir).select("doc_id", M.extract_total(N.fold_text(F.col("text"))).alias("total_amount"))


@query("m5_extract_total_due", f"WITH base AS ({X.base_sql()}) SELECT row_number AS doc_id, amount AS total_amount FROM base")
def _(spark, sf_dir):
    """The amount due, below a larger one that no total cue marks."""
    base = spark.sql(X.base_sql(), **X.tables(spark, sf_dir))
    cue = F.element_at(F.array(*(F.lit(c) for c in ("Amount Due: ", "Balance  due ", "GRAND TOTAL HKD", "Total due: $"))), (F.col("row_number") % 4 + 1).cast("int"))
    text = F.concat(F.lit("Price "), F.format_number(F.col("amount") + 100, 2), F.lit("\nSub-total "), F.format_number(F.col("amount") + 50, 2), F.lit("\n"), cue, F.format_number("amount", 2))
    return base.select(F.col("row_number").alias("doc_id"), M.extract_total(N.fold_text(text)).alias("total_amount"))


@query("m6_quantize", "SELECT o_orderkey AS id, round(CAST(o_totalprice AS DECIMAL(18,2)) / 8 * 8, 2)::DECIMAL(18,2) AS cents, CAST(round(CAST(o_orderkey AS DECIMAL(18,3)) + 0.005, 2) AS DECIMAL(18,2)) AS half FROM orders")
def _(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), M.quantize(F.col("o_totalprice").cast("decimal(18,2)")).alias("cents"), M.quantize(F.col("o_orderkey").cast("decimal(18,3)") + F.lit("0.005").cast("decimal(5,3)")).alias("half"))


@query("m7_amounts_equal", _ledger_sql("SELECT r.row_number AS id, abs(r.amount - i.total_amount) <= 0.01 AS equal FROM requests r JOIN invoices i ON r.batch_id = i.batch_id AND r.row_number = i.invoice_seq WHERE i.total_amount IS NOT NULL"))
def _(spark, sf_dir):
    r, i = X.ledger(spark, sf_dir)
    both = r.join(i.select("batch_id", F.col("invoice_seq").alias("row_number"), "total_amount"), ["batch_id", "row_number"]).where("total_amount IS NOT NULL")
    return both.select(F.col("row_number").alias("id"), M.amounts_equal(F.col("amount"), F.col("total_amount")).alias("equal"))


@query("m8_format_amount", f"WITH base AS ({X.base_sql()}) SELECT row_number AS id, CAST(amount AS STRING) AS plain, format('{{:,.2f}}', amount) AS shown FROM base")
def _(spark, sf_dir):
    r, _i = X.ledger(spark, sf_dir)
    return r.select(F.col("row_number").alias("id"), M.format_amount(F.col("amount")).alias("plain"), M.format_amount_display(F.col("amount")).alias("shown"))


@query("m9_normalise_name", "SELECT c_custkey AS id, lower(replace(c_name, '#', '')) || 'coltd' AS name_key FROM customer")
def _(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("id"), N.normalise_name(F.concat("c_name", F.lit(" (Company), LIMITED."))).alias("name_key"))


@query("m10_normalise_digits", "SELECT c_custkey AS id, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM customer")
def _(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("id"), N.normalise_digits(F.col("c_name")).alias("digits"))


@query("m11_bank_id", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN '004' WHEN 2 THEN '' ELSE '004-' || c_name END AS bank_id FROM customer")
def _(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("k", F.col("c_custkey") % 4)
    return c.select(F.col("c_custkey").alias("id"), N.bank_id(F.when(F.col("k").isin(1, 3), " 004 ").otherwise(" "), F.when(F.col("k").isin(0, 3), F.col("c_name"))).alias("bank_id"))


@query("m12_fold_text", "SELECT c_custkey AS id, '总计:' || c_name AS folded FROM customer")
def _(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("id"), N.fold_text(F.concat(F.lit("總計："), F.translate("c_name", "0123456789", "０１２３４５６７８９"))).alias("folded"))


# ---- 2.5 fields
_CUES_BY_LAYOUT = "CASE doc_id % 3 WHEN 0 THEN ['payee_name', 'bank_code', 'bank_account', 'invoice_no', 'invoice_date'] WHEN 1 THEN ['payee_name', 'bank_code', 'bank_account', 'invoice_no'] ELSE ['payee_name', 'bank_code', 'bank_account'] END"
_FIELD_VALUES = "CASE field WHEN 'payee_name' THEN payee_name WHEN 'bank_code' THEN bank_code WHEN 'bank_account' THEN bank_account WHEN 'invoice_no' THEN invoice_no ELSE '2026/09/08' END"


@query(
    "e1_document_cells",
    _LINES
    + """, split AS (SELECT doc_id, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS line_no, string_split(translate(unnest(lines), '號碼賬帳銀編總計', '号码账帐银编总计'), '  ') AS cells FROM lined)
SELECT doc_id, line_no, CAST(generate_subscripts(cells, 1) - 1 AS INTEGER) AS cell_no, unnest(cells) AS cell, CAST(len(cells) AS INTEGER) AS n_cells FROM split""",
)
def _(spark, sf_dir):
    return E.document_cells(X.invoice_texts(spark, sf_dir))


@query("e2_cue_fields", _LINES + f" SELECT doc_id, unnest({_CUES_BY_LAYOUT}) AS field FROM lined")
def _(spark, sf_dir):
    return E.document_cells(X.invoice_texts(spark, sf_dir)).select("doc_id", F.explode(E.cue_fields(F.col("cell"))).alias("field"))


@query("e3_labelled_values", _LINES + f", f AS (SELECT *, unnest({_CUES_BY_LAYOUT}) AS field FROM lined WHERE doc_id % 3 <> 0) SELECT doc_id, field, {_FIELD_VALUES} AS value FROM f")
def _(spark, sf_dir):
    return E.labelled_values(E.document_cells(X.invoice_texts(spark, sf_dir)))


@query("e4_value_fits", "SELECT o_orderkey AS id, k = 0 AS date_fits, k IN (0, 1) AS no_fits, k IN (2, 3) AS account_fits, k = 3 AS code_fits FROM (SELECT o_orderkey, o_orderkey % 4 AS k FROM orders)")
def _(spark, sf_dir):
    """A date, an invoice number, an account and a bank code, each held against all shapes; dates pass for invoice numbers and codes for accounts."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, padded = F.col("o_orderkey") % 4, F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    value = F.when(k == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).when(k == 1, F.concat(F.lit("INV"), padded)).when(k == 2, F.concat(F.lit("012-345 "), padded)).otherwise(F.substring(padded, 6, 3))
    fits = {"date_fits": "invoice_date", "no_fits": "invoice_no", "account_fits": "bank_account", "code_fits": "bank_code"}
    return o.select(F.col("o_orderkey").alias("id"), *(E.value_fits(field, value).alias(name) for name, field in fits.items()))


@query("e5_caption_row_values", _LINES + f", f AS (SELECT *, unnest({_CUES_BY_LAYOUT}) AS field FROM lined WHERE doc_id % 3 = 0) SELECT doc_id, field, {_FIELD_VALUES} AS value FROM f")
def _(spark, sf_dir):
    return E.caption_values(X.invoice_texts(spark, sf_dir))


@query("e6_letterhead_payee", _LINES + " SELECT doc_id, payee_name FROM lined WHERE doc_id % 3 <> 1")
def _(spark, sf_dir):
    return E.letterhead_payee(E.document_lines(X.invoice_texts(spark, sf_dir)))


@query(
    "e7_parse_invoices",
    _LINES + """ SELECT doc_id, payee_name, bank_code, bank_account, CASE WHEN doc_id % 3 = 2 THEN '' ELSE invoice_no END AS invoice_no, CASE WHEN doc_id % 3 = 0 THEN '2026/09/08' ELSE '' END AS invoice_date, amount AS total_amount, 1 AS n_amounts, 0 AS n_warnings FROM lined""",
)
def _(spark, sf_dir):
    found = E.parse_invoices(X.invoice_texts(spark, sf_dir))
    return found.withColumns({"n_amounts": F.size("amount_candidates"), "n_warnings": F.size("warnings")}).drop("amount_candidates", "warnings")


@query("w2_document_totals")
def _(spark, sf_dir):
    """Amounts in running text, which is full of addresses and card numbers: a load without totals."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", M.extract_total(N.fold_text(F.col("text"))).alias("total_amount"), F.size(F.coalesce(M.amount_values(F.col("text")), F.array().cast("array<decimal(18,2)>"))).alias("n_amounts"))


# ---- 2.6 pairing
@query("p1_split_usable", _ledger_sql("SELECT batch_id, invoice_seq, total_amount FROM invoices WHERE total_amount IS NOT NULL"))
def _(spark, sf_dir):
    return P.split_usable(X.ledger(spark, sf_dir)[1])[0].select("batch_id", "invoice_seq", "total_amount")


@query("p2_name_similarity")
def _(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    a, b = N.normalise_name(F.col("c_name")), N.normalise_name(F.concat(F.reverse("c_name"), F.lit(" Limited")))
    return c.select(F.col("c_custkey").alias("id"), a.alias("a"), b.alias("b")).withColumn("sim", P.name_similarity(F.col("a"), F.col("b")))


@query("p3_exact_name_candidates", _ledger_sql("SELECT DISTINCT r.batch_id, replace(lower(replace(r.payee_name, ' ', '')), 'limited', 'ltd') AS name_key FROM requests r JOIN invoices i ON r.batch_id = i.batch_id AND r.payee_name = i.payee_name"))
def _(spark, sf_dir):
    r, i = X.ledger(spark, sf_dir)
    return P.exact_name_candidates(P.keyed(r), P.keyed(i))


@query("p4_account_candidates", _ledger_sql("SELECT r.batch_id, r.row_number, i.invoice_seq FROM requests r JOIN invoices i ON r.batch_id = i.batch_id AND r.bank_account = i.bank_account AND r.bank_code = i.bank_code", "U"))
def _(spark, sf_dir):
    r, i = X.ledger(spark, sf_dir, "U")
    return P.account_candidates(P.keyed(r), P.keyed(i))


@query("p5_similar_name_candidates")
def _(spark, sf_dir):
    r, i = X.ledger(spark, sf_dir, "L")
    return P.similar_name_candidates(P.keyed(r), P.keyed(i)).select("batch_id", "r_name", "i_name", "sim")


def _scored(spark, sf_dir, variant):
    """(requests, readable invoices, class scores) of a whole ledger."""
    r, i = (P.keyed(t) for t in X.ledger(spark, sf_dir, variant))
    i = P.split_usable(i)[0]
    return r, i, saved(P.class_scores(r, i, saved(P.similar_name_candidates(r, i), "similar")), "scores")


@query("p6_score_candidates")
def _(spark, sf_dir):
    """Pairs by name, misspelt name or account of the whole ledger; similarity is beyond SQL."""
    return P.score_candidates(*_scored(spark, sf_dir, "U"))


@query("p7_assign_one_to_one", _RESULTS + "SELECT batch_id, row_number, invoice_seq, confidence, reason FROM pairs WHERE confidence > 0")
def _(spark, sf_dir):
    r, i = (P.keyed(t) for t in X.ledger(spark, sf_dir))
    return P.assigned(saved(r, "requests"), saved(P.split_usable(i)[0], "invoices"))[0]


@query("p8_rescue_by_amount")
def _(spark, sf_dir):
    """All names lost, no invoice taken yet: requests compete in their order, which is beyond SQL."""
    r, i = X.ledger(spark, sf_dir)
    taken = spark.createDataFrame([], "batch_id string, row_number long, invoice_seq long")
    return P.rescue_by_amount(P.keyed(r.withColumn("payee_name", F.lit("??"))), P.split_usable(P.keyed(i))[0], taken)


@query("p9_attach_unreadable", _ledger_sql("SELECT r.batch_id, r.row_number, min(i.invoice_seq) AS invoice_seq FROM requests r JOIN invoices i ON r.batch_id = i.batch_id AND r.payee_name = i.payee_name WHERE i.total_amount IS NULL GROUP BY 1, 2"))
def _(spark, sf_dir):
    r, i = (P.keyed(t) for t in X.ledger(spark, sf_dir))
    late = P.split_usable(i)[1]
    return P.attach_unreadable(r, late, P.similar_name_candidates(r, late))


@query("p10_pairings", _RESULTS + "SELECT * FROM pairs")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir)[2]


@query("p10_pairings_unique", _ledger_sql("SELECT r.batch_id, r.row_number, i.invoice_seq FROM requests r LEFT JOIN invoices i ON r.batch_id = i.batch_id AND r.row_number = i.invoice_seq AND i.payee_name <> '' OR r.batch_id = i.batch_id AND r.row_number = i.invoice_seq AND i.total_amount IS NOT NULL", "U"))
def _(spark, sf_dir):
    """Fuzzy linkage where every order has a name of its own: the true pair is known by key."""
    return _pairs(spark, sf_dir, "U")[2].select("batch_id", "row_number", "invoice_seq")


@query("p11_unmatched_invoices", _RESULTS + "SELECT batch_id, invoice_seq, source FROM invoices WHERE total_amount IS NULL OR NOT EXISTS (SELECT 1 FROM pairs p WHERE p.batch_id = invoices.batch_id AND p.invoice_seq = invoices.invoice_seq)")
def _(spark, sf_dir):
    _r, i, pairs = _pairs(spark, sf_dir, unreadable=False)
    return P.unmatched_invoices(i, pairs).select("batch_id", "invoice_seq", "source")


# ---- 2.7 verdicts and reports
@query("v1_verify", _RESULTS + "SELECT batch_id, row_number, status, invoice_amount, difference FROM results")
def _(spark, sf_dir):
    return _found(spark, sf_dir).select("batch_id", "row_number", "status", "invoice_amount", "difference")


@query("v1_verify_full")
def _(spark, sf_dir):
    """Verdicts of the ledger with misspelt and empty names and lost amounts, end to end."""
    return reconcile(*X.ledger(spark, sf_dir, "L")).select("batch_id", "row_number", "invoice_seq", "status", "invoice_amount", "difference", "reason")


@query("v2_verdict_note", _RESULTS + "SELECT batch_id, row_number, note FROM results")
def _(spark, sf_dir):
    return _found(spark, sf_dir).select("batch_id", "row_number", "note")


@query("v3_included_excluded", _RESULTS + "SELECT batch_id, row_number, status = 'MATCHED' AS paid FROM results")
def _(spark, sf_dir):
    found = saved(_payable(spark, sf_dir).select("batch_id", "row_number", "status"), "verdicts")
    return V.included(found).select("batch_id", "row_number", F.lit(True).alias("paid")).unionByName(V.excluded(found).select("batch_id", "row_number", F.lit(False).alias("paid")))


@query("a1_bank_lines", _RESULTS + "SELECT batch_id, row_number, request_no, payee_name, bank_code || '-' || bank_account AS bank_id, invoice_amount AS amount FROM results WHERE status = 'MATCHED'")
def bank_lines(spark, sf_dir):
    return A.bank_lines(_payable(spark, sf_dir)).orderBy("batch_id", "row_number")


@query(
    "a2_bank_total_row",
    _RESULTS + """SELECT batch_id, row_number, request_no, payee_name, bank_code || '-' || bank_account AS bank_id, CAST(invoice_amount AS DECIMAL(28,2)) AS amount FROM results WHERE status = 'MATCHED'
UNION ALL SELECT batch_id, NULL, NULL, NULL, 'TOTAL', CAST(coalesce(sum(CASE WHEN status = 'MATCHED' THEN invoice_amount END), 0) AS DECIMAL(28,2)) FROM results GROUP BY batch_id""",
)
def _(spark, sf_dir):
    return A.bank_total_row(_payments(spark, sf_dir))


@query(
    "a3_batch_totals",
    _RESULTS + "SELECT batch_id, count(*) AS n_requests, count(*) FILTER (status = 'MATCHED') AS n_included, count(*) FILTER (status <> 'MATCHED') AS n_excluded, CAST(sum(CASE WHEN status = 'MATCHED' THEN invoice_amount ELSE 0 END) AS DECIMAL(28,2)) AS total_payable FROM results GROUP BY batch_id",
)
def _(spark, sf_dir):
    return A.batch_totals(_payable(spark, sf_dir))


@query("a4_counts_by_status", _RESULTS + "SELECT b.batch_id, s.status, (SELECT count(*) FROM results r WHERE r.batch_id = b.batch_id AND r.status = s.status) AS n FROM (SELECT DISTINCT batch_id FROM results) b, (VALUES ('MATCHED'), ('AMOUNT_MISMATCH'), ('NO_INVOICE'), ('UNREADABLE')) AS s(status)")
def _(spark, sf_dir):
    return A.counts_by_status(_found(spark, sf_dir))


@query("a5_exclusions_by_reason", _RESULTS + "SELECT batch_id, CASE status WHEN 'AMOUNT_MISMATCH' THEN 'Amount mismatch' WHEN 'NO_INVOICE' THEN 'No invoice' ELSE 'Unreadable invoice' END AS reason, count(*) AS n FROM results WHERE status <> 'MATCHED' GROUP BY 1, 2")
def _(spark, sf_dir):
    return A.exclusions_by_reason(_found(spark, sf_dir))


@query("a6_audit_rows", _RESULTS + _AUDIT_SQL.format(**{c: c for c in S.AUDIT_COLUMNS}))
def _(spark, sf_dir):
    return A.audit_rows(_found(spark, sf_dir))


@query(
    "a7_screen_rows",
    _RESULTS
    + """SELECT batch_id, row_number, CASE WHEN status = 'MATCHED' THEN 'PASS' ELSE 'HOLD' END AS badge, request_no, payee_name, format('{:,.2f}', amount) AS requested, coalesce(source, '-') AS invoice_file,
coalesce(format('{:,.2f}', invoice_amount), '') AS invoice_amount, coalesce(CASE WHEN difference >= 0 THEN '+' ELSE '' END || format('{:,.2f}', difference), '-') AS difference, status,
CASE source_kind WHEN 'TEXT_LAYER' THEN 'PDF text layer' WHEN 'OCR_LOCAL' THEN 'Offline OCR' WHEN 'OCR_VISION' THEN 'Cloud vision OCR' ELSE '-' END AS read_via, note AS remark FROM results""",
)
def _(spark, sf_dir):
    return A.screen_rows(_found(spark, sf_dir))


@query(
    "a8_batch_warnings",
    _RESULTS
    + """, idle AS (SELECT batch_id, invoice_seq, source, total_amount IS NULL AS late FROM invoices WHERE total_amount IS NULL OR NOT EXISTS (SELECT 1 FROM pairs p WHERE p.batch_id = invoices.batch_id AND p.invoice_seq = invoices.invoice_seq))
SELECT batch_id, source || ': No amount figure could be located on the document.' AS warning FROM invoices WHERE total_amount IS NULL
UNION ALL SELECT batch_id, 'Invoice(s) provided but not matched to any payment request: ' || string_agg(source, ', ' ORDER BY late, invoice_seq) FROM idle GROUP BY batch_id""",
)
def _(spark, sf_dir):
    _r, i, pairs = _pairs(spark, sf_dir, unreadable=False)
    none = spark.createDataFrame([], "batch_id string, warning string, reason string")
    return A.batch_warnings(none.select("batch_id", "warning"), none.select("batch_id", "reason"), i, P.unmatched_invoices(i, pairs))


#: Sheets with uneven invoices, for the other engine: rows that are read, invoices that are there, and which go together.
_UNEVEN = (
    _SHEET
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY file, payee_name ORDER BY row_number) AS nth FROM good),
i AS (SELECT substr(batch_id, 1, 1) AS file, row_number AS invoice_seq, payee_name, CAST(CASE k WHEN 3 THEN NULL WHEN 1 THEN amount + 5000 WHEN 2 THEN amount + 0.01 ELSE amount END AS DECIMAL(18,2)) AS total_amount FROM base WHERE k <> 0),
u AS (SELECT *, row_number() OVER (PARTITION BY file, payee_name ORDER BY invoice_seq) AS nth FROM i WHERE total_amount IS NOT NULL),
late AS (SELECT file, payee_name, min(invoice_seq) AS invoice_seq FROM i WHERE total_amount IS NULL GROUP BY 1, 2),
found AS (SELECT r.file AS batch_id, r.row_number, coalesce(u.invoice_seq, late.invoice_seq) AS invoice_seq, u.total_amount AS invoice_amount, CAST(r.amount - u.total_amount AS DECIMAL(18,2)) AS difference,
    CASE WHEN u.invoice_seq IS NOT NULL THEN CASE WHEN abs(r.amount - u.total_amount) <= 0.01 THEN 'MATCHED' ELSE 'AMOUNT_MISMATCH' END WHEN late.invoice_seq IS NOT NULL THEN 'UNREADABLE' ELSE 'NO_INVOICE' END AS status
  FROM r LEFT JOIN u ON r.file = u.file AND r.payee_name = u.payee_name AND r.nth = u.nth LEFT JOIN late ON r.file = late.file AND r.payee_name = late.payee_name AND u.invoice_seq IS NULL)
"""
)


def _uneven(spark, sf_dir):
    """Sheets and texts of invoices of which some are missing, some ask for more and some are illegible."""
    raw = X.raw_rows(spark, sf_dir)
    batches = spark.sql(X.base_sql(), **X.tables(spark, sf_dir)).select(F.substring("batch_id", 1, 1).alias("batch_id"), F.col("row_number").alias("doc_id"))
    parsed = E.parse_invoices(X.invoice_texts(spark, sf_dir, uneven=True)).join(batches, "doc_id")
    invoices = parsed.select("batch_id", F.col("doc_id").alias("invoice_seq"), F.concat(F.lit("INV"), F.col("doc_id"), F.lit(".pdf")).alias("source"), F.lit("TEXT_LAYER").alias("source_kind"), "total_amount", "payee_name", "bank_code", "bank_account", "warnings")
    return verify_batches(raw, saved(invoices, "invoices"))


@query("a9_verify_batches_held", _UNEVEN + "SELECT batch_id, row_number, status, invoice_seq, invoice_amount, difference FROM found")
def _(spark, sf_dir):
    """Sheets and texts with every outcome, end to end."""
    return _uneven(spark, sf_dir).results.select("batch_id", "row_number", "status", "invoice_seq", "invoice_amount", "difference")


@query(
    "a8_warnings_of_a_run",
    _UNEVEN
    + """, idle AS (SELECT file, invoice_seq, total_amount IS NULL AS late FROM i WHERE total_amount IS NULL OR NOT EXISTS (SELECT 1 FROM found WHERE found.batch_id = i.file AND found.invoice_seq = i.invoice_seq))
SELECT '5' AS batch_id, 'Summary is missing expected column(s): bank_account, bank_code. Matching will be less reliable.' AS warning
UNION ALL SELECT file, 'Row ' || CAST(row_number AS STRING) || CASE WHEN no_payee THEN ': no payee name -- skipped.' ELSE ': no readable payment amount for ''' || payee_name || ''' -- skipped.' END FROM sheet WHERE NOT blank AND (no_payee OR no_amount) AND NOT (thin AND no_payee AND no_amount)
UNION ALL SELECT file, 'INV' || CAST(invoice_seq AS STRING) || '.pdf: No amount figure could be located on the document.' FROM i WHERE total_amount IS NULL
UNION ALL SELECT file, 'Invoice(s) provided but not matched to any payment request: ' || string_agg('INV' || CAST(invoice_seq AS STRING) || '.pdf', ', ' ORDER BY late, invoice_seq) FROM idle GROUP BY file""",
)
def _(spark, sf_dir):
    """Warnings of sheets, rows, invoices and what stays over, all of one run."""
    return _uneven(spark, sf_dir).warnings


@query(
    "a9_verify_batches",
    _SHEET + """, parsed AS (SELECT file, row_number, payee_name, amount, thin FROM good)
SELECT file AS batch_id, count(*) AS n_requests, count(*) AS n_included, CAST(0 AS BIGINT) AS n_excluded, CAST(sum(amount) AS DECIMAL(28,2)) AS total_payable FROM parsed GROUP BY file""",
)
def _(spark, sf_dir):
    """Sheets and rendered invoice texts of the rows that they hold, end to end."""
    raw = X.raw_rows(spark, sf_dir)
    held = R.requests(raw).select(F.col("batch_id").alias("file"), (F.col("row_number") - 10).alias("doc_id"))
    parsed = E.parse_invoices(X.invoice_texts(spark, sf_dir)).join(held, "doc_id")
    invoices = parsed.select(F.col("file").alias("batch_id"), F.col("doc_id").alias("invoice_seq"), F.concat(F.lit("INV"), F.col("doc_id"), F.lit(".pdf")).alias("source"), F.lit("TEXT_LAYER").alias("source_kind"), "total_amount", "payee_name", "bank_code", "bank_account", "warnings")
    return verify_batches(raw, saved(invoices, "invoices")).totals
