import glob
import random
import time

from pyspark.sql import functions as F

from tallyloom.operators import boxes as B
from tallyloom.operators import report as A
from tallyloom.sources import sinks as S


def first_fit(boxes, overlap=0.5, gap=24.0):
    """Lines of one page, box by box."""
    rows = []
    for top, bottom, left, right, text in sorted(boxes, key=lambda b: (b[0], b[2])):
        for row in rows:
            low, high = min(b[0] for b in row), max(b[1] for b in row)
            shared = min(bottom, high) - max(top, low)
            if shared > 0 and shared / min(max(bottom - top, 1.0), max(high - low, 1.0)) >= overlap:
                row.append((top, bottom, left, right, text))
                break
        else:
            rows.append([(top, bottom, left, right, text)])
    lines = []
    for row in sorted(rows, key=lambda r: min(b[0] for b in r)):
        line, edge = "", None
        for _, _, left, right, text in sorted(row, key=lambda b: b[2]):
            if text:
                line += ("" if edge is None else "  " if left - edge > gap else " " if left > edge else "") + text
            edge = right
        if line.strip():
            lines.append(line.strip())
    return lines


def page(rnd, n, height):
    """Boxes of distinct places."""
    places = rnd.sample(range(height * 600), n)
    return [(float(p // 600), float(p // 600 + rnd.randint(-2, 30)), float(p % 600), float(p % 600 + rnd.randint(0, 60)), rnd.choice(["", "a", "bc", "def", "12.50", " "])) for p in places]


def lines_of(spark, pages):
    rows = [(d, 1, *b) for d, boxes in enumerate(pages) for b in boxes]
    got = B.boxes_to_lines(spark.createDataFrame(rows, "doc_id int, page_no int, top double, bottom double, left double, right double, text string")).collect()
    out = [[] for _ in pages]
    for r in sorted(got, key=lambda r: (r["doc_id"], r["line_no"])):
        out[r["doc_id"]].append(r["line"])
    return out


def test_lines_against_plain_first_fit(spark):
    rnd = random.Random(4)
    pages = [page(rnd, n, h) for n, h in ((1, 50), (30, 60), (150, 300), (150, 3000), (80, 20), (300, 900))]
    assert lines_of(spark, pages) == [first_fit(p) for p in pages]


def test_a_page_of_four_thousand_boxes_takes_seconds(spark):
    dense = page(random.Random(5), 4000, 8000)
    lines_of(spark, [dense[:10]])
    began = time.time()
    got = lines_of(spark, [dense])
    assert time.time() - began < 30 and got == [first_fit(dense)]


def test_a_large_batch_is_written_in_ordered_parts_with_its_total(spark, tmp_path):
    lines = spark.range(3000).select(F.when(F.col("id") % 4 == 0, "small").otherwise("large").alias("batch_id"), F.col("id").alias("row_number"), F.format_string("P%05d", "id").alias("request_no"), F.lit('A "quoted", name\\').alias("payee_name"), F.lit("004-1").alias("bank_id"), (F.col("id") / 100).cast("decimal(18,2)").alias("amount"), F.lit("MATCHED").alias("status"))
    found = lines.withColumns({"invoice_amount": F.col("amount")}).unionByName(lines.limit(1).withColumns({"batch_id": F.lit("none"), "status": F.lit("NO_INVOICE"), "invoice_amount": F.lit(None).cast("decimal(18,2)")}))
    manifest = S.write_batches(lines, S.BANK_COLUMNS, str(tmp_path), "PAY", A.total_rows(found)).orderBy("batch_id", "part").collect()
    large = [r for r in manifest if r["batch_id"] == "large"]
    assert len(large) >= 3 and sum(r["n_rows"] for r in large) == 2250 and max(r["n_rows"] for r in large) < 1200
    assert all(a["last_row"] < b["first_row"] for a, b in zip(large, large[1:]))
    for batch, n in (("small", 750), ("large", 2250), ("none", 0)):
        files = sorted(glob.glob(f"{tmp_path}/PAY_bank_payment_file/batch_id={batch}/*/*/*.csv"))
        texts = [open(f, encoding="utf-8").read().splitlines() for f in files]
        assert all(t[0] == ",".join(S.BANK_COLUMNS.values()) for t in texts)
        rows = [line for t in texts for line in t[1:]]
        mine = [k for k in range(3000) if (k % 4 == 0) == (batch == "small")] if n else []
        assert [r.split(",")[0] for r in rows[:-1]] == [f"P{k:05d}" for k in mine]
        assert rows[-1].endswith(f"TOTAL,{sum(mine) / 100:.2f}")
    back = S.read_batches(spark, f"{tmp_path}/PAY_bank_payment_file", "request_no string, payee_name string, bank_id string, amount decimal(28,2)")
    assert back.where("section = '1-lines'").select("payee_name").distinct().first()[0] == 'A "quoted", name\\' and back.count() == 3003
