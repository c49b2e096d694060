from decimal import Decimal

from tallyloom.operators import boxes as B
from tallyloom.operators import fields as E
from tallyloom.sources import sheets as R

TABLE = "INVOICE\nInvoice Number  Invoice Date\n140981024  2026/09/08\nPayee Name  Bank Code  Bank Account Number\nABC Medical Centre Limited  004  123456789\nTotalAmount:HKD15,000.00"
BESIDE = "發票\n收款人：  XYZ Office Supplies Limited\n銀行編號  004\n銀行賬戶號碼  456-789123\n項目  金額\n文具  5,800.00\n小計  6,000.00\n總計  5,800.00"
BELOW = "Healthy Imaging Centre Limited\nTax Invoice\nPayee Name\nHealthy Imaging Centre Limited\nBank Code: 024\nBank Account Number\n987654321\nTOTAL\n120,000.00"
HEAD = "Sunrise Trading Co\nTel 12345\nTotal 9.00"


def parsed(spark, texts):
    rows = E.parse_invoices(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [(r["payee_name"], r["bank_code"], r["bank_account"], r["invoice_no"], r["invoice_date"], r["total_amount"], len(r["warnings"])) for r in rows]


def test_three_layouts_and_odd_texts(spark):
    got = parsed(spark, [TABLE, BESIDE, BELOW, HEAD, "", None])
    assert got[0] == ("ABC Medical Centre Limited", "004", "123456789", "140981024", "2026/09/08", Decimal("15000.00"), 0)
    assert got[1] == ("XYZ Office Supplies Limited", "004", "456789123", "", "", Decimal("5800.00"), 0)
    assert got[2] == ("Healthy Imaging Centre Limited", "024", "987654321", "", "", Decimal("120000.00"), 0)
    assert got[3] == ("Sunrise Trading Co", "", "", "", "", Decimal("9.00"), 0)
    assert got[4] == got[5] == ("", "", "", "", "", None, 1)


def test_boxes(spark):
    boxes = [(482, 502, 10, 60, "Payee"), (484, 504, 70, 120, "Name"), (500, 520, 400, 460, "low"), (486, 505, 200, 260, "ABC"), (490, 500, 255, 300, "DEF"), (700, 720, 0, 10, ""), (701, 719, 12, 20, "end")]
    kinds = "doc_id long, page_no int, top double, bottom double, left double, right double, text string"
    df = spark.createDataFrame([(7, 1, *(float(x) for x in b[:4]), b[4]) for b in boxes], kinds)
    assert [r["line"] for r in B.boxes_to_lines(df).orderBy("line_no").collect()] == ["Payee Name  ABCDEF", "low", "end"]
    assert B.boxes_to_lines(spark.createDataFrame([], kinds)).count() == 0


def test_boxes_table(spark):
    rows = [("d", 1, 0.0, 10.0, 0.0, 5.0, "a"), ("d", 1, 0.0, 10.0, 6.0, 9.0, "b"), ("d", 1, 40.0, 50.0, 0.0, 9.0, None), ("d", 2, None, 1.0, 0.0, 1.0, "x"), (None, 1, 0.0, 1.0, 0.0, 1.0, "n")]
    df = spark.createDataFrame(rows, "doc_id string, page_no int, top double, bottom double, left double, right double, text string")
    assert sorted((tuple(r) for r in B.boxes_to_lines(df).collect()), key=str) == [("d", 1, 0, "a b"), (None, 1, 0, "n")]


def sheet(spark, rows, file="f"):
    return spark.createDataFrame([(file, i + 1, r) for i, r in enumerate(rows)], "file string, row_number long, cells array<string>")


def test_sheets(spark):
    rows = [["Summary"], [None], ["Request No", "Beneficiary", "Bank Code", "Account No", "Description", "Amount (HKD)"], ["P1", " ABC ", "004", "123", "x", "HKD 1,000"], ["P2", None, "", "", "", "5"], ["", "DEF", "", "", "", "n/a"], [None, None], ["", "GHI", "1"], [None, "JKL", None, None, None, "7.5"]]
    raw = sheet(spark, rows)
    got = R.requests(raw).orderBy("row_number").collect()
    assert [(r["request_no"], r["payee_name"], r["bank_code"], r["amount"]) for r in got] == [("P1", "ABC", "004", Decimal("1000")), ("ROW9", "JKL", "", Decimal("7.5"))]
    assert sorted(r["reason"] for r in R.skipped(raw).collect()) == ["Row 5: no payee name -- skipped.", "Row 6: no readable payment amount for 'DEF' -- skipped.", "Row 8: no readable payment amount for 'GHI' -- skipped."]
    assert R.check_summary(raw).count() == 0
    assert {r["field"]: r["caption"] for r in R.header_map(raw).collect()}["payment_amount"] == "Amount (HKD)"
    odd = sheet(spark, [["nothing"], ["here"]], "a").unionByName(sheet(spark, [["Payee Name", "Payment Amount"]], "b"))
    assert sorted((r["file"], r["warning"][:20]) for r in R.check_summary(odd).collect()) == [("a", R.NO_HEADER[:20]), ("b", R.NO_ROWS[:20]), ("b", "Summary is missing e")]


def test_caption_split_over_two_cells(spark):
    text = "Payee Name  Bank  Account Number\nABC  123\n"
    docs = spark.createDataFrame([(1, "Payee Name  Invoice  Number\nABC  12345"), (2, text)], "doc_id long, text string")
    got = {(r["doc_id"], r["field"]): r["value"] for r in E.caption_row_values(E.document_lines(docs)).collect()}
    # a cell is only merged into a caption before it
    assert got == {}
    one = spark.createDataFrame([(1, "Payee Name  Due Date  Bank Account  Number\nABC  2026-01-02  12-3")], "doc_id long, text string")
    assert {r["field"]: r["value"] for r in E.caption_row_values(E.document_lines(one)).collect()} == {"payee_name": "ABC", "due_date": "2026-01-02", "bank_account": "12-3"}


def test_texts_are_read_without_a_meeting_of_rows(spark):
    """One exchange deals the texts out; fields, captions and letterheads are found within the row."""
    docs = spark.createDataFrame([(1, TABLE), (2, "Payee Name  Invoice Date\u3000 Due Date\n A B \u00a0 2026/01/02  x")], "doc_id long, text string")
    for found in (E.parse_invoices(docs), E.caption_values(docs)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan
    by_rows = lambda d: sorted(map(tuple, d.collect()))
    assert by_rows(E.caption_values(docs)) == by_rows(E.caption_row_values(E.document_lines(docs)))
    assert {(2, "payee_name", "A B"), (2, "invoice_date", "2026/01/02")} <= set(by_rows(E.caption_values(docs)))


def test_words_that_labels_hold():
    """A Latin label without one of the words would be passed over."""
    for pattern in E.FIELD_CUES.values():
        for way in pattern.replace(r"(?:number|no\.?|號碼|号码)?", "").replace(r"(?:no\.?|number|#)", "no").split("|"):
            assert any(w in way for w in E.CUE_WORDS) or not way.isascii(), way
