import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.text import SHORT_FORMS
from tallyloom.operators import amounts
from tallyloom.operators import linkage as P
from tallyloom.operators import queues
from tallyloom.operators.components import components
from tallyloom.operators.ranks import ranked
from tallyloom.plans.batches import reconcile, verify_batches
from tallyloom.streaming.documents import watch_totals

REQUESTS = "batch_id string, row_number long, request_no string, payee_name string, bank_code string, bank_account string, particulars string, amount decimal(18,6)"
INVOICES = "batch_id string, invoice_seq long, source string, source_kind string, total_amount decimal(18,2), payee_name string, bank_code string, bank_account string"


def key(name):
    out = "".join(c for c in (name or "").lower() if c.isalnum() or c == "_")
    for a, b in SHORT_FORMS:
        out = out.replace(a, b)
    return out


def digits(x):
    return "".join(c for c in x or "" if c.isdigit())


def slow(requests, invoices):
    """All pairs, one batch at a time: (batch, row) -> (invoice, confidence)."""
    out = {}
    for batch in {r[0] for r in requests}:
        rs = sorted((r for r in requests if r[0] == batch), key=lambda r: r[1])
        iv = sorted((i for i in invoices if i[0] == batch), key=lambda i: i[1])
        usable, late = [i for i in iv if i[4] is not None], [i for i in iv if i[4] is None]
        scored = []
        for a, r in enumerate(rs):
            for b, i in enumerate(usable):
                sim = P.ratio(key(r[3]), key(i[5]))
                account = bool(digits(r[5])) and digits(r[5]) == digits(i[7]) and (not digits(i[6]) or digits(i[6]) == digits(r[4]))
                if sim < P.NAME_EVIDENCE and not account:
                    continue
                score = max(sim, P.ACCOUNT_FLOOR) + 0.1 if account else sim
                score += 0.05 if abs(r[7] - i[4]) <= 0.0101 else 0
                scored.append((-min(score, 1.0), a, b))
        used_r, used_i = {}, set()
        for s, a, b in sorted(scored):
            if a not in used_r and b not in used_i:
                used_r[a] = (usable[b][1], -s)
                used_i.add(b)
        for a, r in enumerate(rs):
            if a not in used_r and len(key(r[3])) < 4:
                free = [b for b, i in enumerate(usable) if b not in used_i and abs(r[7] - i[4]) <= 0.0101]
                if len(free) == 1:
                    used_r[a] = (usable[free[0]][1], 0.5)
                    used_i.add(free[0])
        for a, r in enumerate(rs):
            if a not in used_r:
                like = [i for i in late if P.ratio(key(r[3]), key(i[5])) >= P.NAME_EVIDENCE]
                used_r[a] = (like[0][1], 0.0) if like else (None, 0.0)
            out[batch, r[1]] = used_r[a]
    return out


def batches(seed, n=45):
    rnd = random.Random(seed)
    names = ["Abcdef Trading Limited", "Abcdeg Trading Ltd", "Qwerty Medical Centre", "Qwerty Medical", "Zephyr Corp", "ab", "x", "", "Solar Wind Incorporated", "Solar Winds Inc", "Lunar", "北京有限公司"]
    spoil = lambda s: s if rnd.random() < 0.7 or not s else s[:-1] + rnd.choice("qz")
    requests, invoices = [], []
    for b in "AB":
        for k in range(n):
            payee = rnd.choice([x for x in names if x])
            requests.append((b, k * 2, f"P{k}", payee, rnd.choice(["004", "024", ""]), rnd.choice(["123", "456", "78-9", "-", ""]), "", float(rnd.choice([100, 200, 300, 100.01]))))
            if rnd.random() < 0.9:
                invoices.append((b, k * 3, f"i{k}.pdf", "OCR_LOCAL", rnd.choice([100.0, 200.0, 300.0, 300.01, None]), spoil(rnd.choice([payee, payee, rnd.choice(names)])), rnd.choice(["004", "024", ""]), rnd.choice(["123", "456", "789", ""])))
    return requests, invoices


def frames(spark, requests, invoices):
    from decimal import Decimal

    money = lambda v: None if v is None else Decimal(str(v))
    r = spark.createDataFrame([(*x[:7], money(x[7])) for x in requests], REQUESTS)
    i = spark.createDataFrame([(*x[:4], money(x[4]), *x[5:]) for x in invoices], INVOICES)
    return r, i


@pytest.mark.parametrize("seed", [1, 2])
def test_pairings_against_all_pairs(spark, seed):
    requests, invoices = batches(seed)
    r, i = frames(spark, requests, invoices)
    got = {(x["batch_id"], x["row_number"]): (x["invoice_seq"], x["confidence"]) for x in P.pairings(r, i).collect()}
    want = slow(requests, invoices)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_accounts_of_many_names_against_all_pairs(spark, monkeypatch):
    """All accounts taken for busy: no pair of unlike names is listed, and rows and reasons are the same."""
    requests, invoices = batches(3)
    r, i = frames(spark, requests, invoices)
    listed = sorted(map(tuple, P.pairings(r, i).collect()), key=str)
    monkeypatch.setattr(P, "LISTED_PAIRS", 0)
    monkeypatch.setattr(P, "NAME_BLOCK", 2)
    got = sorted(map(tuple, P.pairings(r, i).collect()), key=str)
    assert got == listed
    want = slow(requests, invoices)
    assert {k[:2]: k[2] for k in got} == {k: v[0] for k, v in want.items()}
    assert {0.65, 0.7} <= {round(v[1], 6) for v in want.values()}  # unlike names on one account, without and with the amount


def test_a_busy_account_is_not_listed_squared(spark):
    rnd = random.Random(21)
    name = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(9, 16)))
    left = [name() for _ in range(1200)]
    right = [w[:-1] + "z" if k % 4 == 0 else name() for k, w in enumerate(left)]
    rows = lambda names: spark.createDataFrame([("b", w, "77", "") for w in names], "batch_id string, name_key string, account_key string, code_key string")
    r, i = rows(left), rows(right)
    busy = P.busy_accounts(r, i)
    assert [tuple(x) for x in busy.collect()] == [("b", "77")]
    none = spark.createDataFrame([], "batch_id string, r_name string, i_name string, sim double")
    got = {(x["r_name"], x["i_name"]): x["sim"] for x in P.class_scores(r, i, none, busy, 0.55).collect()}
    assert {(w, right[k]) for k, w in enumerate(left) if k % 4 == 0} <= set(got) and len(got) < len(left) * len(right) / 50
    assert all(v > 0.55 for v in got.values())
    some = rnd.sample(left, 12)
    assert {k for k in got if k[0] in some} == {(a, b) for a in some for b in set(right) if P.ratio(a, b) > 0.55}


def test_large_parts_level_by_level(spark, monkeypatch):
    """All parts taken for large: levels, walks of a few requests a turn, ranks in ranges."""
    monkeypatch.setattr(P, "PART_ROWS", 0)
    monkeypatch.setattr(queues, "TURN", 15)
    monkeypatch.setattr(P, "greedy", None)  # the helper is not needed
    rnd = random.Random(9)
    names = ["Solar Wind Trading", "Solar Wimd Trading", "Solar Wind Tradimg", ""]  # one account with all of them, misspelt or empty, and rows without it
    requests = [("b", k, "P", rnd.choice(names[:3]), "004", rnd.choice(["77", "77", ""]), "", rnd.choice([100.0, 100.01, 200.0, 300.0])) for k in range(40)]
    invoices = [("b", k, "i", "OCR_LOCAL", rnd.choice([100.0, 100.02, 200.0, 300.0, 400.0]), rnd.choice(names), rnd.choice(["004", ""]), rnd.choice(["77", "77", ""])) for k in range(36)]
    r, i = (P.keyed(t) for t in frames(spark, requests, invoices))
    scores = P.class_scores(r, i, P.similar_name_candidates(r, i))
    got = {(x["batch_id"], x["row_number"]): (x["invoice_seq"], x["confidence"]) for x in P.assign_one_to_one(r, i, scores).collect()}
    want = {k: v for k, v in slow(requests, invoices).items() if v[1] > 0.5}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len({round(v[1], 6) for v in want.values()}) > 2
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


@pytest.mark.parametrize("turn", [7, 100])
def test_walks_in_turns_against_one_walk(spark, turn):
    rnd = random.Random(turn)
    requests = [(p, rnd.randint(0, 3), k) for p in (1, 2) for k in rnd.sample(range(500), 60)]
    invoices = [(p, rnd.randint(0, 3), k) for p in (1, 2) for k in rnd.sample(range(500), 50)]
    allowed = [(p, g, q) for p in (1, 2) for g in range(4) for q in range(4) if rnd.random() < 0.5]
    table = lambda rows, columns: spark.createDataFrame(rows, ", ".join(f"{c} long" for c in columns.split()))
    got = queues.served(table(requests, "part grp at"), table(invoices, "part queue at"), table(allowed, "part grp queue"), turn).collect()
    want = []
    for p in (1, 2):
        free = defaultdict(list)
        for _, q, k in sorted(x for x in invoices if x[0] == p):
            free[q].append(k)
        ways = {g: [q for a, b, q in allowed if (a, b) == (p, g)] for g in range(4)}
        want += [(p, a, b) for a, b, _ in queues.walk([(k, g) for x, g, k in requests if x == p], free, ways)]
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_ranks_in_ranges(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("aaaaaaab") if rnd.random() < 0.9 else None, k) for k in rnd.sample(range(9999), 900)]
    got = ranked(spark.createDataFrame(rows, "key string, at long").repartition(6), ["key"], ["at"]).collect()
    seen = Counter()
    want = []
    for key, at in sorted(rows, key=lambda x: x[1]):
        seen[key] += 1
        want.append((key, at, seen[key]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_rescues_in_turn_against_a_plain_walk(spark):
    rnd = random.Random(11)
    requests = [("b", k, "P", "??", "", "", "", rnd.choice([100.0, 100.01, 100.02, 100.03, 200.0, 300.0, 300.01, 400.0 + k])) for k in range(60)]
    invoices = [("b", k, "i", "OCR_LOCAL", v, "", "", "") for k, v in enumerate([100.0, 100.02, 200.0, 200.0, 300.01, 300.02, *(400.0 + k for k in range(0, 60, 3)), 407.0])]
    r, i = frames(spark, requests, invoices)
    none = spark.createDataFrame([], "batch_id string, row_number long, invoice_seq long")
    got = sorted((x["row_number"], x["invoice_seq"]) for x in P.rescue_by_amount(P.keyed(r), P.keyed(i), none).collect())
    used, want = set(), []
    for x in requests:
        free = [v[1] for v in invoices if v[1] not in used and abs(x[7] - v[4]) <= 0.0101]
        if len(free) == 1:
            used.add(free[0])
            want.append((x[1], free[0]))
    assert got == want and len(want) >= 4


def turns(requests, invoices, tolerance):
    """(request, invoice) of a plain walk; rows are (number, cents)."""
    free, out = defaultdict(set), []
    for n, c in invoices:
        free[c].add(n)
    for n, c in sorted(requests):
        near = [(v, x) for v in range(c - tolerance, c + tolerance + 1) for x in free.get(v, ())]
        if len(near) == 1:
            free[near[0][0]].discard(near[0][1])
            out.append((n, near[0][1]))
    return sorted(out)


@pytest.mark.parametrize(("tolerance", "step", "order"), [(1, 1, "random"), (1, 2, "rising"), (1, 2, "falling"), (3, 2, "random")])
def test_chained_amounts_in_pieces_against_a_plain_walk(spark, monkeypatch, tolerance, step, order):
    """One island of amounts, cut into pieces: chains of choices run across their borders, or all along."""
    monkeypatch.setattr(amounts, "PIECE_ROWS", 60)
    rnd = random.Random(tolerance + step)
    cents = [k * step for k in range(400)] + [rnd.randrange(400 * step) for _ in range(200)]
    numbers = {"random": rnd.sample(range(10_000), len(cents)), "rising": range(len(cents)), "falling": range(len(cents), 0, -1)}[order]
    requests = list(zip(numbers, cents))
    invoices = [(n, k * step + 1) for n, k in enumerate(range(0, 400))] if order != "random" else [(n, c) for n, c in enumerate(rnd.sample(range(400 * step), 200 * step // 2))] + [(1000 + k, 7) for k in range(2)]
    table = lambda rows, names: spark.createDataFrame([("b", *x) for x in rows], f"batch_id string, {names}")
    got = amounts.only_choices(table(requests, "row_number long, rc long"), table(invoices, "invoice_seq long, ic long"), tolerance).collect()
    assert sorted((r["row_number"], r["invoice_seq"]) for r in got) == turns(requests, invoices, tolerance)
    assert order == "random" or len(got) > 20


def test_a_hundred_thousand_chained_amounts(spark, monkeypatch):
    monkeypatch.setattr(amounts, "PIECE_ROWS", 20_000)
    rows = spark.range(100_000).select(F.lit("b").alias("batch_id"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("row_number"), F.col("id").alias("rc"))
    invoices = spark.range(100_000).where(F.xxhash64("id") % 3 == 0).select(F.lit("b").alias("batch_id"), F.col("id").alias("invoice_seq"), F.col("id").alias("ic"))
    got = amounts.only_choices(rows, invoices, 1).toPandas()
    want = turns([(r["row_number"], r["rc"]) for r in rows.collect()], [(r["invoice_seq"], r["ic"]) for r in invoices.collect()], 1)
    assert sorted(zip(got["row_number"], got["invoice_seq"])) == want and len(want) > 10_000


def test_hot_payee_with_a_misspelt_invoice_is_paired_by_rank(spark):
    requests = [("b", k, "P", "Solar Wind Limited", "004", "77", "", float(k % 7)) for k in range(400)]
    invoices = [("b", k, "i", "OCR_LOCAL", float(k % 5), "Solar Wind Limited" if k % 100 else "Solar Wimd Limited", "004", "77") for k in range(380)]
    r, i = (P.keyed(t) for t in frames(spark, requests, invoices))
    best = P.best_class_scores(r, i)
    solve, P.greedy = P.greedy, None  # the helper is not needed: all pairs of this part score 1
    try:
        got = P.assign_one_to_one(r, i, best, least=1.0).collect()
    finally:
        P.greedy = solve
    assert sorted((x["row_number"], x["invoice_seq"]) for x in got) == [(k, k) for k in range(380)]


def test_similar_names_lose_no_pair(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 14))) for _ in range(150)] + ["a", "bc", "abcabcabc", "abcabc"]
    words += [w[:-2] + rnd.choice("abcd") for w in words if len(w) > 5]
    rows = spark.createDataFrame([("b", w) for w in words], "batch_id string, name_key string")
    got = {(r["r_name"], r["i_name"]) for r in P.similar_name_candidates(rows, rows).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and P.ratio(a, b) >= P.NAME_EVIDENCE}


def test_short_names_meet_in_proportion(spark):
    """Names of four letters: what the index brings together, against all pairs."""
    rnd = random.Random(12)
    names = sorted({"".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.choice([3, 4, 4, 4, 5, 6, 7]))) for _ in range(1500)})
    rows = spark.createDataFrame([("b", w) for w in names], "batch_id string, name_key string").withColumn("len", F.length("name_key"))
    sides = rows.withColumn("side", F.lit("r")).unionByName(rows.withColumn("side", F.lit("i")))
    met = {(r["r_name"], r["i_name"]) for r in P._share_letters_in_order(sides, P.NAME_EVIDENCE).collect()}
    short = {(a, b) for a in names for b in names if a != b and len(a) + len(b) in (5, 8, 11) and a not in b and b not in a and P.ratio(a, b) >= P.NAME_EVIDENCE}
    assert short <= met and len(met) < 12 * len(names)


def test_letters_in_common_against_a_table():
    def plain(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for k, d in enumerate(y):
                last, row[k + 1] = row[k + 1], (last + 1 if c == d else max(row[k], row[k + 1]))
        return row[-1]

    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdé𝄞") for _ in range(rnd.choice([1, 2, 5, 20, 63, 64])))
    left, right = [word() for _ in range(400)], [word() for _ in range(400)]
    assert P.common_letters(left, right).tolist() == [plain(x, y) for x, y in zip(left, right)]
    assert P.common_letters([], []).tolist() == []
    good = P.worth_comparing(left, right, 0.72)
    assert all(g or P.ratio(x, y) < 0.72 for g, x, y in zip(good, left, right)) and not good.all()


def test_golden_batch(spark):
    requests = [("g", 1, "P000001", "ABC Medical Centre Limited", "004", "123456789", "", 15000.0), ("g", 2, "P000002", "XYZ Office Supplies Limited", "004", "456789123", "", 5800.0), ("g", 3, "P000003", "Healthy Imaging Centre Limited", "024", "987654321", "", 125000.0)]
    invoices = [("g", 1, "a.pdf", "TEXT_LAYER", 15000.0, "ABCMedical CentreLimited", "004", "123456789"), ("g", 2, "b.pdf", "OCR_LOCAL", 5800.0, "XYZ Office Supplies Limited", "004", "456789123"), ("g", 3, "c.pdf", "OCR_LOCAL", 120000.0, "Healthy Imaging Centre Limited", "024", "987654321")]
    found = reconcile(*frames(spark, requests, invoices)).orderBy("row_number").collect()
    assert [(r["status"], float(r["difference"])) for r in found] == [("MATCHED", 0.0), ("MATCHED", 0.0), ("AMOUNT_MISMATCH", 5000.0)]
    assert found[2]["note"] == "Requested 125000.00 but invoice 'c.pdf' shows 120000.00 (difference +5000.00); excluded from the bank file."


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e if n is not None}
    for _ in range(500):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    linked = {n for a, b in edges if a is not None and a != b for n in (a, b)}
    assert got == {n: root[n] for n in linked}


def test_batches_end_to_end(spark):
    rows = [["Payee Name", "Bank Code", "Bank Account Number", "Payment Amount"], ["Alpha Limited", "004", "1", "10"], ["Beta Limited", "004", "2", "20"], [None, "", "", "3"]]
    raw = spark.createDataFrame([("g", k + 1, r) for k, r in enumerate(rows)] + [("empty", 1, ["Payee Name", "Amount"])], "file string, row_number long, cells array<string>")
    _, invoices = frames(spark, [], [("g", 1, "a.pdf", "OCR_LOCAL", 10.0, "Alpha Ltd", "004", "1"), ("g", 2, "b.pdf", "OCR_LOCAL", None, "Beta Ltd", "004", "2")])
    report = verify_batches(raw, invoices.withColumn("warnings", F.array().cast("array<string>")))
    assert [tuple(r)[:4] for r in report.totals.collect()] == [("g", 2, 1, 1)]
    assert Counter(r["status"] for r in report.results.collect()) == Counter(MATCHED=1, UNREADABLE=1)
    assert report.warnings.where("batch_id = 'g'").count() == 2


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Total 5.00"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    watch_totals(spark, f"{tmp_path}/in", f"{tmp_path}/out", tmp_path.name).awaitTermination(60)
    assert sorted((r[0], r[1] and float(r[1])) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 5.0), (2, None)]
