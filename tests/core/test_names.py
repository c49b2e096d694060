import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import linkage as P
from tallyloom.operators import names as N
from tallyloom.plans.batches import reconcile
from tallyloom.storage import released, saved

ROW = "batch_id string, name_key string"


@pytest.mark.parametrize("columns", [64, 6])
def test_blocks_of_names_against_all_pairs(monkeypatch, columns):
    """With few columns of the product most letters are slack."""
    monkeypatch.setattr(N, "COLUMNS", columns)
    monkeypatch.setattr(N, "LETTERS", 3 if columns == 6 else 96)
    monkeypatch.setattr(N, "SLAB", 7)
    monkeypatch.setattr(N, "PAIRS", 11)
    rnd = random.Random(columns)
    words = {"".join(rnd.choice("abcdé𝄞") for _ in range(n)) for n in (1, 2, 4, 8, 17, 33, 64, 70) for _ in range(12)}
    words |= {w[:-1] for w in words if len(w) > 1} | {w[:3] + "z" + w[4:] for w in words if len(w) > 4}
    blocks: dict[int, list[str]] = {}
    for w in sorted(words):
        blocks.setdefault(len(w), []).append(w)
    for threshold in (0.72, 0.9):
        got = [(a, b) for x in blocks.values() for y in blocks.values() for a, b, _ in N.alike(x, y, threshold, P.CONTAINED, P.ratio)]
        assert sorted(got) == sorted((a, b) for a in words for b in words if a != b and P.ratio(a, b) >= threshold)


def test_names_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 5)
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.choice([6, 7]))) for _ in range(60)})
    rows = spark.createDataFrame([("b", w) for w in words] + [("other", words[0])], ROW)
    got = sorted((r["batch_id"], r["r_name"], r["i_name"]) for r in P.similar_name_candidates(rows, rows).collect())
    assert got == sorted(("b", a, b) for a in words for b in words if a != b and P.ratio(a, b) >= P.NAME_EVIDENCE)


def test_names_of_lengths_that_ask_for_all_letters_are_not_searched(spark, monkeypatch):
    """Of 17 letters on both sides, 0.95 asks for 17: no letter pairs are listed."""
    for step in ("_share_rare_pairs", "_share_letters_in_order", "_numbered"):
        monkeypatch.setattr(P, step, None)
    rows = spark.range(300).select(F.lit("b").alias("batch_id"), F.substring(F.md5(F.col("id").cast("string")), 1, 17).alias("name_key"))
    assert P.similar_name_candidates(rows, rows, P.BEST_NAME).isEmpty()


def _ledger(spark, n):
    rows = spark.range(n).withColumn("batch_id", F.lit("b"))
    name = F.concat(F.lit("Payee "), F.substring(F.md5((F.col("id") % 40).cast("string")), 1, 12))
    r = rows.select("batch_id", F.col("id").alias("row_number"), name.alias("payee_name"), F.lit("1").alias("bank_code"), F.lit("").alias("bank_account"), F.lit(5).cast("decimal(18,6)").alias("amount"))
    total = F.when(F.col("id") % 9 != 0, F.col("id") % 2 + 4).cast("decimal(18,2)")
    i = rows.where("id % 7 > 0").select("batch_id", F.col("id").alias("invoice_seq"), F.lit("s").alias("source"), F.lit("OCR_LOCAL").alias("source_kind"), total.alias("total_amount"), name.alias("payee_name"), F.lit("1").alias("bank_code"), F.lit("").alias("bank_account"))
    return r, i


def test_names_apart_from_others_need_no_classes(spark, monkeypatch):
    """They are paired by rank, without components; what is paid is known without a look at unreadable invoices."""
    r, i = _ledger(spark, 400)
    told = {x["row_number"]: x["status"] for x in reconcile(r, i).collect()}
    assert {"MATCHED", "AMOUNT_MISMATCH", "UNREADABLE"} <= set(told.values())
    for step in ("class_scores", "components", "attach_unreadable"):
        monkeypatch.setattr(P, step, None)
    paid = {x["row_number"]: x["status"] for x in reconcile(r, i, unreadable=False).collect()}
    assert paid == {k: "NO_INVOICE" if v == "UNREADABLE" else v for k, v in told.items()}


def test_a_payee_of_many_rows_goes_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(P, "PART_ROWS", 30)
    r, i = _ledger(spark, 400)
    r, i = (d.withColumn("payee_name", F.when(F.col(c) % 3 == 0, "Solar Wind").otherwise(F.col("payee_name"))) for d, c in ((r, "row_number"), (i, "invoice_seq")))
    keyed = [P.keyed(d) for d in (r, i.where("total_amount IS NOT NULL"))]
    assert [tuple(x) for x in P.entangled_names(*keyed).collect()] == [("b", "solarwind")]
    got = P.assigned(*keyed)[0].collect()
    monkeypatch.setattr(P, "PART_ROWS", 100_000)
    assert sorted(map(tuple, got)) == sorted(map(tuple, P.assigned(*keyed)[0].collect())) and len(got) > 200


def test_released_tables_are_gone(spark, tmp_path):
    from tallyloom import storage

    kept, gone = saved(spark.range(3).toDF("id"), "kept"), saved(spark.range(3).toDF("id"), "gone")
    released(gone, spark.range(2))
    assert storage.shared_folder(spark) and kept.count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(gone.saved_path)
