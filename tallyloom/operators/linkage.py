"""Pairing payment requests with invoices: candidates, scores, one-to-one assignment.

Nothing here lists request x invoice pairs.  Pairs that score 1 are made first: names that
meet no other at that score are paired rank by rank.  For the rest, similarity and account
evidence are found between distinct names, and components over classes of equal rows split
each batch into independent parts.  Parts in which all pairs score 1 are paired rank by
rank; small others go through the greedy order in a helper, and large ones level by level.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import amounts_equal, quantize
from ..functions.text import normalise_digits, normalise_name
from ..storage import released, saved
from .amounts import only_choices
from .components import components
from .levels import by_levels
from .names import similar_in_blocks
from .ranks import ranked

#: Least similarity of names that is evidence; what an account is worth without it.
NAME_EVIDENCE, ACCOUNT_FLOOR = 0.72, 0.55
CONTAINED = 0.92
#: Least similarity that can score 1 by amount alone; an account is worth 0.1 more.
BEST_NAME = 0.95
UNMATCHED = "no supporting document matched"
BY_AMOUNT = "payee name unreadable; paired by unique matching invoice amount"
UNREADABLE = "document matched by payee name but its amount could not be read"


def split_usable(invoices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(invoices with a total, those without)."""
    return invoices.where("total_amount IS NOT NULL"), invoices.where("total_amount IS NULL")


def keyed(rows: DataFrame) -> DataFrame:
    """Add name_key, account_key and code_key."""
    return rows.withColumns({"name_key": normalise_name(F.col("payee_name")), "account_key": normalise_digits(F.col("bank_account")), "code_key": normalise_digits(F.col("bank_code"))})


def ratio(left: str, right: str) -> float:
    """Similarity of two normalised names; the request's comes first, the measure isn't symmetric."""
    if not left or not right:
        return 0.0
    if left == right:
        return 1.0
    if left in right or right in left:
        return CONTAINED
    return SequenceMatcher(None, left, right).ratio()


def common_letters(left: list[str], right: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair of names of up to 64 letters, all pairs at once.

    A bit of a pair's word stands for a letter of the left name; each letter of the right
    one carries through the bits where it occurs (the bits that are 0 at the end count).
    """
    n = len(left)
    a, b = (np.array(side, dtype=str) if n else np.zeros(0, "U1") for side in (left, right))
    x, y = (v.view(np.uint32).reshape(n, -1) if n else np.zeros((0, 1), np.uint32) for v in (a, b))
    ones, seen = np.uint64(1) << np.arange(x.shape[1], dtype=np.uint64), np.full(n, ~np.uint64(0))
    for column in y.T:
        # a place beyond a name's end holds 0, which is no letter
        where = np.where((x == column[:, None]) & (x != 0), ones, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        step = seen & where
        seen = (seen + step) | (seen - step)
    inside = (x != 0) @ ones
    return np.bitwise_count(~seen & inside).astype(int)


def worth_comparing(left: list[str], right: list[str], threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold: enough letters in common, in order, or one inside the other.

    Matched blocks stand in the same order in both names, so they hold no more letters than
    the longest common subsequence.  Names of over 64 letters are all worth it.
    """
    good = np.array([max(len(x), len(y)) > 64 or x in y or y in x for x, y in zip(left, right)], bool)
    for at in range(0, len(left), 4096):
        rest = at + np.flatnonzero(~good[at : at + 4096])
        some = [left[k] for k in rest], [right[k] for k in rest]
        total = np.array([len(x) + len(y) for x, y in zip(*some)], float)
        good[rest] = 2 * common_letters(*some) >= threshold * total - 1e-9
    return good


def name_similarity(left: Column, right: Column, threshold: float = 0.0) -> Column:
    """``ratio`` of two columns of normalised names, in Arrow batches; for distinct pairs.

    With a threshold, pairs that can't reach it give 0 without being compared.
    """

    @F.pandas_udf("double")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.fillna("").tolist(), b.fillna("").tolist()
        good = worth_comparing(x, y, threshold) if threshold and x else np.ones(len(x), bool)
        return pd.Series([ratio(p, q) if g else 0.0 for p, q, g in zip(x, y, good)], dtype="float64")

    return compare(left, right)


def exact_name_candidates(requests: DataFrame, invoices: DataFrame) -> DataFrame:
    """batch_id, name_key that both tables have, names that aren't empty; one row a name."""
    names = lambda d: d.where("name_key <> ''").select("batch_id", "name_key").distinct()
    return names(requests).join(names(invoices), ["batch_id", "name_key"])


def account_classes(requests: DataFrame, invoices: DataFrame) -> DataFrame:
    """Distinct request and invoice classes (batch, name, account, code) whose accounts agree.

    Accounts agree if their digits do, and the invoice has no code or the same one.  Accounts
    without a digit agree with none.
    """
    cls = lambda d, p: d.where("account_key <> ''").select("batch_id", F.col("name_key").alias(f"{p}_name"), "account_key", F.col("code_key").alias(f"{p}_code")).distinct()
    both = cls(requests, "r").join(cls(invoices, "i"), ["batch_id", "account_key"])
    return both.where((F.col("i_code") == "") | (F.col("i_code") == F.col("r_code")))


def account_candidates(requests: DataFrame, invoices: DataFrame) -> DataFrame:
    """batch_id, row_number, invoice_seq of rows whose accounts agree (a list of pairs: for small tables and checks)."""
    r = requests.where("account_key <> ''").select("batch_id", "row_number", "account_key", F.col("code_key").alias("r_code"))
    i = invoices.where("account_key <> ''").select("batch_id", "invoice_seq", "account_key", F.col("code_key").alias("i_code"))
    return r.join(i, ["batch_id", "account_key"]).where((F.col("i_code") == "") | (F.col("i_code") == F.col("r_code"))).select("batch_id", "row_number", "invoice_seq")


def _numbered(items: Column) -> Column:
    """Items with a running number among equals before them: a multiset as a set."""
    again = F.transform(items, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(items, F.lit(1), i + 1), lambda y: y == x))))
    return F.when(F.size(F.array_distinct(items)) == F.size(items), F.transform(items, lambda x: F.concat(x, F.lit("#1")))).otherwise(again)


def _grams(name: Column, n: int) -> Column:
    return F.when(F.length(name) >= n, F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substring(name, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _least_matched(total: Column, threshold: float) -> Column:
    """Letters that two names of ``total`` letters together must have in matched blocks."""
    return F.ceil(F.lit(threshold / 2) * total - 1e-9)


def _pairs_asked(total: Column, threshold: float) -> Column:
    """Letter pairs that those blocks hold at least: blocks are parted by unmatched letters, of which there are few."""
    return (3 * _least_matched(total, threshold) - total - 1).cast("int")


def _may_differ(total: Column, longer: Column, threshold: float) -> Column:
    """Can unequal names be alike?  Not where all letters of both must be matched."""
    return _least_matched(total, threshold) < longer


def _parity(items: Column) -> Column:
    """How many items fall to each of 64 places, modulo 2: bags that differ in d items differ in d bits at most."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    return F.aggregate(items, F.lit(0).cast("long"), lambda seen, x: seen.bitwiseXOR(bit(x)))


def _side(rows: DataFrame, side: str, *columns: str) -> DataFrame:
    """Rows of one side with its letter in front of the columns' names."""
    return rows.where(F.col("side") == side).select("batch_id", "gram", *(F.col(c).alias(f"{side}_{c}") for c in columns))


def _share_rare_pairs(names: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Names that hold one or two of each other's rarest letter pairs, and much the same letters.

    Where two names must share c pairs, two of them (one if c is 1) are among the n - c + 2
    rarest of either.  Which number that is depends on the partner's length, so the join is by
    both lengths.  Their letters may differ by what is not matched only.
    """
    often = pairs.groupBy("batch_id", "gram").agg(F.count(F.lit(1)).alias("df"))
    ranked = pairs.join(often, ["batch_id", "gram"]).withColumn("nth", F.row_number().over(W.partitionBy("batch_id", "side", "name_key").orderBy("df", "gram")))
    lengths = names.select("batch_id", F.when(F.col("side") == "r", "i").otherwise("r").alias("side"), F.col("len").alias("other")).distinct()
    total = F.col("len") + F.col("other")
    asked = ranked.join(lengths, ["batch_id", "side"]).where((2 * F.least("len", "other") >= threshold * total) & _may_differ(total, F.greatest("len", "other"), threshold))
    asked = asked.withColumn("c", _pairs_asked(total, threshold)).where("c >= 1").withColumn("two", F.least("c", F.lit(2)))
    rare = asked.where(F.col("nth") <= F.col("len") - 1 - F.col("c") + F.col("two"))
    left = _side(rare, "r", "nid", "bag", "two", "len", "other").withColumnsRenamed({"r_len": "r", "r_other": "i"})
    right = _side(rare, "i", "nid", "bag", "len", "other").withColumnsRenamed({"i_len": "i", "i_other": "r"})
    both = F.col("r") + F.col("i")
    close = F.bit_count(F.col("r_bag").bitwiseXOR(F.col("i_bag"))) <= both - 2 * _least_matched(both, threshold)
    met = left.join(right, ["batch_id", "gram", "r", "i"]).where((F.col("r_nid") != F.col("i_nid")) & close)
    met = met.groupBy("r_nid", "i_nid", "r_two").agg(F.count(F.lit(1)).alias("n")).where("n >= r_two")
    named = lambda side: names.where(F.col("side") == side).select(F.col("nid").alias(f"{side}_nid"), F.col("batch_id").alias(f"{side}_batch"), F.col("name_key").alias(f"{side}_name"))
    return met.join(named("r"), "r_nid").join(named("i"), "i_nid").select(F.col("r_batch").alias("batch_id"), "r_name", "i_name")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _subsequences(names: pd.Series, letters: pd.Series) -> pd.Series:
    """All different strings of so many letters that are left of a name when others go."""
    return pd.Series([sorted({"".join(c) for c in combinations(name, m)}) for name, m in zip(names, letters)], dtype=object)


def _share_letters_in_order(names: DataFrame, threshold: float) -> DataFrame:
    """Short names, of which no letter pair is asked, with as many letters in common, in order, as must be matched.

    How many that are depends on both lengths, so names are indexed by what is left of them
    when all but that many letters go, once for each length of a partner.
    """
    lengths = names.select("batch_id", F.when(F.col("side") == "r", "i").otherwise("r").alias("side"), F.col("len").alias("other")).distinct()
    total = F.col("len") + F.col("other")
    least = _least_matched(total, threshold).cast("int")
    asked = names.join(lengths, ["batch_id", "side"]).where((2 * F.least("len", "other") >= threshold * total) & _may_differ(total, F.greatest("len", "other"), threshold) & (_pairs_asked(total, threshold) < 1))
    kept = asked.withColumn("gram", F.explode(_subsequences(F.col("name_key"), least)))
    left = _side(kept, "r", "name_key", "len", "other").withColumnsRenamed({"r_len": "a", "r_other": "b"})
    right = _side(kept, "i", "name_key", "len", "other").withColumnsRenamed({"i_len": "b", "i_other": "a"})
    met = left.join(right, ["batch_id", "gram", "a", "b"])
    return met.select("batch_id", F.col("r_name_key").alias("r_name"), F.col("i_name_key").alias("i_name")).distinct()


def similar_name_candidates(left: DataFrame, right: DataFrame, threshold: float = NAME_EVIDENCE) -> DataFrame:
    """batch_id, r_name, i_name, sim of unequal names alike to ``threshold`` or more.

    left and right have batch_id and name_key.  No pair is lost.  Up to ``CONTAINED`` a name is
    like too many others for an index to tell them apart, so all are compared, in blocks (see
    ``names``).  Over it names are met by what they share: for names of S letters
    together, M matched ones and M >= threshold * S / 2, the matched blocks hold at least
    3 * M - S - 1 letter pairs, so names that share fewer can't be alike; where that number
    is not positive (short names) they are met by the M letters that both hold in one order.
    Names of lengths at which all letters must be matched are not searched for at all.
    """
    distinct = lambda rows: rows.where("name_key <> ''").select("batch_id", "name_key").distinct()
    if threshold <= CONTAINED:
        return similar_in_blocks(distinct(left), distinct(right), threshold, CONTAINED, ratio)
    sized = lambda rows, to: rows.where("name_key <> ''").select("batch_id", F.length("name_key").alias(to)).distinct()
    total = F.col("len") + F.col("other")
    lengths = sized(left, "len").join(sized(right, "other"), "batch_id").where((2 * F.least("len", "other") >= threshold * total) & _may_differ(total, F.greatest("len", "other"), threshold))
    lengths = saved(lengths, "name-lengths")
    kind = left.schema["batch_id"].dataType.simpleString()
    if lengths.isEmpty():
        return left.sparkSession.createDataFrame([], f"batch_id {kind}, r_name string, i_name string, sim double")
    own = lambda rows, side, c: distinct(rows).withColumn("len", F.length("name_key")).join(lengths.select("batch_id", F.col(c).alias("len")).distinct(), ["batch_id", "len"], "left_semi").withColumn("side", F.lit(side))
    names = own(left, "r", "len").unionByName(own(right, "i", "other")).withColumns({"nid": F.xxhash64("batch_id", "name_key"), "bag": _parity(_grams(F.col("name_key"), 1))})
    names = saved(names, "names")
    pairs = saved(names.withColumn("gram", F.explode(_numbered(_grams(F.col("name_key"), 2)))), "name-grams")
    found = _share_rare_pairs(names, pairs, threshold).unionByName(_share_letters_in_order(names, threshold))
    found = found.where("r_name <> i_name").distinct()
    found = saved(found.withColumn("sim", name_similarity(F.col("r_name"), F.col("i_name"), threshold)).where(F.col("sim") >= threshold), "alike")
    released(names, pairs, lengths)
    return found


#: Class pairs that an account may list; those of busier accounts are listed only where names are alike.
LISTED_PAIRS = 10_000
#: Names of a side that are compared at once with as many of the other.
NAME_BLOCK = 256


def _classes(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("batch_id", F.col("name_key").alias(f"{side}_name"), F.col("account_key").alias(f"{side}_account"), F.col("code_key").alias(f"{side}_code")).distinct()


def busy_accounts(requests: DataFrame, invoices: DataFrame) -> DataFrame:
    """batch_id, account_key of accounts with over ``LISTED_PAIRS`` pairs of classes."""
    sizes = [_classes(d, s).where(F.col(f"{s}_account") != "").groupBy("batch_id", F.col(f"{s}_account").alias("account_key")).agg(F.count(F.lit(1)).alias(f"n{s}")) for d, s in ((requests, "r"), (invoices, "i"))]
    return sizes[0].join(sizes[1], ["batch_id", "account_key"]).where(F.col("nr") * F.col("ni") > LISTED_PAIRS).select("batch_id", "account_key")


def _compare_blocks(least: float):
    """Rows with a block of names a side to rows of the names alike to over ``least``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for batch, account, left, right in zip(pdf["batch_id"], pdf["account"], pdf["left"], pdf["right"]):
                x, y = [n for n in left for _ in right], [n for _ in left for n in right]
                rows = [(batch, account, x[k], y[k], ratio(x[k], y[k])) for k in np.flatnonzero(worth_comparing(x, y, least))]
                yield pd.DataFrame([r for r in rows if r[-1] > least], columns=["batch_id", "account", "r_name", "i_name", "sim"])

    return run


def alike_on_accounts(r: DataFrame, i: DataFrame, least: float) -> DataFrame:
    """batch_id, account, r_name, i_name, sim of names of one account that are alike to over ``least``.

    r and i are classes.  An account's names are cut into blocks, and each two blocks are
    compared where they meet: tasks are of one size, and pairs that are not alike are
    never rows.
    """

    def blocks(classes: DataFrame, side: str, to: str) -> DataFrame:
        names = classes.where(F.col(f"{side}_name") != "").select("batch_id", F.col(f"{side}_account").alias("account"), F.col(f"{side}_name").alias("name")).distinct()
        sizes = names.groupBy("batch_id", "account").agg(F.ceil(F.count(F.lit(1)) / NAME_BLOCK).alias("n"))
        placed = names.join(sizes, ["batch_id", "account"]).withColumn("block", F.pmod(F.xxhash64("name"), F.col("n")))
        return placed.groupBy("batch_id", "account", "block").agg(F.collect_list("name").alias(to)).withColumnRenamed("block", f"{side}_block")

    met = blocks(r, "r", "left").join(blocks(i, "i", "right"), ["batch_id", "account"])
    # each two blocks are some seconds of work at most: spread them over all tasks
    spread = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "batch_id", "account", "r_block", "i_block")
    kind = r.schema["batch_id"].dataType.simpleString()
    return spread.mapInPandas(_compare_blocks(least), f"batch_id {kind}, account string, r_name string, i_name string, sim double")


def class_scores(requests: DataFrame, invoices: DataFrame, similar: DataFrame, busy: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """Scores between classes (batch, name, account, code) of requests and invoices, without the amount.

    batch_id, r_name, r_account, r_code, i_name, i_account, i_code, sim, account_evidence: classes with
    evidence by name or account only.  Of the accounts in ``busy``, pairs by account are
    listed only where the names are alike to over ``least``.
    """
    r, i = _classes(requests, "r"), _classes(invoices, "i")
    exact = exact_name_candidates(requests, invoices).select("batch_id", F.col("name_key").alias("r_name"), F.col("name_key").alias("i_name"), F.lit(1.0).alias("sim"))
    by_name = r.join(exact.unionByName(similar.select("batch_id", "r_name", "i_name", "sim")), ["batch_id", "r_name"]).join(i, ["batch_id", "i_name"])
    agree = (F.col("r_account") == F.col("i_account")) & (F.col("r_account") != "") & ((F.col("i_code") == "") | (F.col("i_code") == F.col("r_code")))
    keys = ["batch_id", "r_name", "r_account", "r_code", "i_name", "i_account", "i_code"]
    # an invoice has the request's code or none
    asking = r.where("r_account <> ''").withColumns({"account": F.col("r_account"), "code": F.explode(F.array_distinct(F.array("r_code", F.lit(""))))})
    offered = i.where("i_account <> ''").withColumns({"account": F.col("i_account"), "code": F.col("i_code")})
    both = by_name.select(*keys, "sim")
    if busy is None:
        by_account = asking.join(offered, ["batch_id", "account", "code"])
    else:
        full = busy.withColumnRenamed("account_key", "account")
        by_account = asking.join(full, ["batch_id", "account"], "left_anti").join(offered, ["batch_id", "account", "code"])
        many, few = (d.join(full, ["batch_id", "account"], "left_semi") for d in (asking, offered))
        alike = saved(alike_on_accounts(many, few, least), "alike-on-accounts")
        listed = many.join(alike, ["batch_id", "account", "r_name"]).join(few, ["batch_id", "account", "code", "i_name"])
        both = both.unionByName(listed.select(*keys, "sim"))
    both = both.unionByName(by_account.select(*keys, F.lit(None).cast("double").alias("sim")))
    merged = both.groupBy(*keys).agg(F.max("sim").alias("sim"))
    return merged.withColumn("sim", F.coalesce("sim", name_similarity(F.col("r_name"), F.col("i_name")))).withColumn("account_evidence", agree)


def best_class_scores(requests: DataFrame, invoices: DataFrame, busy: DataFrame | None = None) -> DataFrame:
    """The class pairs of ``class_scores`` that score 1, at least where amounts agree: without account evidence that takes names alike to 0.95."""
    similar = saved(similar_name_candidates(requests, invoices, BEST_NAME), "most-similar")
    scores = class_scores(requests, invoices, similar, busy, BEST_NAME - 0.1 - 2e-9)
    return scores.where(F.col("sim") >= F.when(F.col("account_evidence"), BEST_NAME - 0.1).otherwise(BEST_NAME) - 1e-9)


def score_columns(sim: Column, account: Column, amount: Column) -> tuple[Column, Column]:
    """(score, reason) of a pair with evidence, added up in the order that ties depend on."""
    score = F.when(account, F.greatest(sim, F.lit(ACCOUNT_FLOOR)) + 0.1).otherwise(sim)
    score = F.least(F.when(amount, score + 0.05).otherwise(score), F.lit(1.0))
    named = F.when(sim != 0, F.concat(F.lit("name similarity "), F.format_string("%.2f", F.bround(sim, 2))))
    reason = F.concat_ws(", ", named, F.when(account, "bank account matches"), F.when(amount, "invoice total agrees with the requested amount"))
    return score, reason


def score_candidates(requests: DataFrame, invoices: DataFrame, scores: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """batch_id, row_number, invoice_seq, score, reason of row pairs (a list of pairs: for small tables and checks)."""
    r = requests.select("batch_id", "row_number", "amount", F.col("name_key").alias("r_name"), F.col("account_key").alias("r_account"), F.col("code_key").alias("r_code"))
    i = invoices.select("batch_id", "invoice_seq", "total_amount", F.col("name_key").alias("i_name"), F.col("account_key").alias("i_account"), F.col("code_key").alias("i_code"))
    pairs = r.join(scores, ["batch_id", "r_name", "r_account", "r_code"]).join(i, ["batch_id", "i_name", "i_account", "i_code"])
    score, reason = score_columns(F.col("sim"), F.col("account_evidence"), amounts_equal(F.col("amount"), F.col("total_amount"), tolerance))
    return pairs.select("batch_id", "row_number", "invoice_seq", score.alias("score"), reason.alias("reason"))


def greedy(requests: list[tuple[int, int, int]], invoices: list[tuple[int, int, int]], base: dict[tuple[int, int], tuple[float, bool]], tolerance: int, least: float = 0.0) -> list[tuple[int, int, float, float, bool, bool]]:
    """One-to-one pairs in the order of falling score down to ``least``, then request, then invoice.

    Rows are (index, class, cents); base has (similarity, account evidence) of classes.  Scores
    depend on the classes and on whether the amounts agree, so each level of score is one
    pass over the requests, and each class of invoices a list from which the first that is
    left is taken.  Where amounts need not agree none do any more: the higher level of the
    same classes has paired all that could.  Returns (request, invoice, score, similarity, account, amount agrees).
    """
    by_class, by_cents = defaultdict(list), defaultdict(list)
    for at, cls, cents in sorted(invoices):
        by_class[cls].append((at, cents))
        by_cents[cls, cents].append(at)
    levels: dict[float, dict[int, list[tuple[int, bool]]]] = defaultdict(lambda: defaultdict(list))
    for (r, i), (sim, account) in base.items():
        plain = max(sim, ACCOUNT_FLOOR) + 0.1 if account else sim
        without, with_ = min(plain, 1.0), min(plain + 0.05, 1.0)
        if without == with_:
            levels[without][r].append((i, True))
        else:
            levels[with_][r].append((i, False))
            levels[without][r].append((i, True))
    used: set[int] = set()
    heads: dict = defaultdict(int)

    def first(key, rows: list, at=lambda x: x):
        while heads[key] < len(rows) and at(rows[heads[key]]) in used:
            heads[key] += 1
        return rows[heads[key]] if heads[key] < len(rows) else None

    out, waiting = [], sorted(requests)
    for level in sorted((x for x in levels if x >= least), reverse=True):
        rest = []
        for row in waiting:
            index, cls, cents = row
            best = None
            for i, others in levels[level].get(cls, ()):
                options = []
                if others:
                    options.append(first(i, by_class[i], lambda x: x[0]))
                else:
                    for c in range(cents - tolerance, cents + tolerance + 1):
                        at = first((i, c), by_cents.get((i, c), []))
                        options.append(None if at is None else (at, c))
                for x in options:
                    if x is not None and (best is None or x[0] < best[0]):
                        best = (*x, i)
            if best is None:
                rest.append(row)
                continue
            used.add(best[0])
            sim, account = base[cls, best[2]]
            out.append((index, best[0], level, sim, account, abs(best[1] - cents) <= tolerance))
        waiting = rest
    return out


def _class_of_row(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cls", F.xxhash64("batch_id", "name_key", "account_key", "code_key"))


#: Rows of a part that one task takes; larger parts are ranked in ranges, or paired level by level.
PART_ROWS = 100_000


def assign_one_to_one(requests: DataFrame, invoices: DataFrame, scores: DataFrame, tolerance: str = "0.01", least: float = 0.0) -> DataFrame:
    """batch_id, row_number, invoice_seq, confidence, reason: the greedy assignment, every row used once at most.

    scores has class pairs (see ``class_scores``); pairs of rows that score under ``least``
    are not made.  Components over classes are independent.  Where every request of a
    component scores 1 with every invoice of it, the k-th request gets the k-th invoice,
    whatever their number.  Other components of up to ``PART_ROWS`` rows go through the greedy
    order in one task each; larger ones level by level (see ``levels``), in tasks of a
    bounded size.
    """
    names = lambda p: [F.col(f"{p}_{c}") for c in ("name", "account", "code")]
    sure = F.least(F.when(F.col("account_evidence"), F.greatest("sim", F.lit(ACCOUNT_FLOOR)) + 0.1).otherwise(F.col("sim")), F.lit(1.0)) >= 1.0
    pairs = scores.select("batch_id", F.xxhash64("batch_id", *names("r")).alias("rc"), F.xxhash64("batch_id", *names("i")).alias("ic"), "sim", "account_evidence", sure.alias("sure"))
    pairs = saved(pairs, "class-pairs")
    node = lambda side, c: F.xxhash64(F.lit(side), c)
    parts = saved(components(pairs.select(node("r", "rc").alias("a"), node("i", "ic").alias("b"))), "parts")
    placed = pairs.withColumn("node", node("r", "rc")).join(parts, "node").drop("node")
    shape = placed.groupBy("root").agg(F.count_if("sure").alias("n"), F.count_distinct("rc").alias("nr"), F.count_distinct("ic").alias("ni"), F.count(F.lit(1)).alias("n_pairs"))
    cents = lambda c: (quantize(F.col(c)) * 100).cast("long").alias("cents")
    own = lambda rows, side, at, to, amount: _class_of_row(rows).withColumn("node", node(side, "cls")).join(parts, "node").select("batch_id", "root", F.col(at).alias("at"), F.col("cls").alias(to), cents(amount))
    r, i = own(requests, "r", "row_number", "rc", "amount"), own(invoices, "i", "invoice_seq", "ic", "total_amount")
    rows_in = r.select("root").unionByName(i.select("root")).groupBy("root").agg(F.count(F.lit(1)).alias("rows"))
    whole, large = F.col("n") == F.col("nr") * F.col("ni"), F.col("rows") + F.col("n_pairs") > PART_ROWS
    shape = shape.join(rows_in, "root").select("root", "rows", F.when(whole & large, "ranges").when(whole, "ranks").when(large, "levels").otherwise("helper").alias("way"))
    shape = saved(shape, "part-shapes")
    ways = {x[0] for x in shape.select("way").distinct().collect()}
    shaped = shape.select("root", "way")
    r, i = r.join(shaped, "root"), i.join(shaped, "root")
    tol = int(round(float(tolerance) * 100))
    found = []

    def by_rank(way: str, rank: Callable[[DataFrame], DataFrame]) -> None:
        left = rank(r.where(F.col("way") == way).drop("way")).withColumnsRenamed({"at": "row_number", "cents": "r_cents"})
        right = rank(i.where(F.col("way") == way).drop("way")).withColumnsRenamed({"at": "invoice_seq", "cents": "i_cents"})
        both = left.join(right, ["batch_id", "root", "k"]).withColumn("confidence", F.lit(1.0))
        found.append(both.join(pairs.drop("batch_id", "sure"), ["rc", "ic"]))

    if "ranks" in ways:
        by_rank("ranks", lambda d: d.withColumn("k", F.row_number().over(W.partitionBy("batch_id", "root").orderBy("at"))))
    if "ranges" in ways:
        by_rank("ranges", lambda d: ranked(d, ["batch_id", "root"], ["at"]))
    if "levels" in ways:
        big = placed.join(shaped.where("way = 'levels'"), "root")
        paired = by_levels(*(d.where("way = 'levels'").drop("way", "batch_id") for d in (r, i)), big.select("rc", "ic", "sim", "account_evidence"), tol, ACCOUNT_FLOOR, least)
        found.append(paired.join(pairs.drop("sure"), ["rc", "ic"]))
    columns = ["batch_id", "row_number", "invoice_seq", "confidence", "sim", F.col("account_evidence").alias("account"), (F.abs(F.col("r_cents") - F.col("i_cents")) <= tol).alias("amount")]
    found = [d.select(*columns) for d in found]

    row = lambda kind, rows, one, two, at, cents, sim, account: rows.where("way = 'helper'").select("batch_id", "root", F.lit(kind).alias("kind"), F.col(one).alias("one"), two.alias("two"), at.alias("at"), cents.alias("cents"), sim.alias("sim"), account.alias("account"))
    zero, none, no = F.lit(0).cast("long"), F.lit(0.0), F.lit(False)
    rows = row("r", r, "rc", zero, F.col("at"), F.col("cents"), none, no).unionByName(row("i", i, "ic", zero, F.col("at"), F.col("cents"), none, no))
    rows = rows.unionByName(row("s", placed.join(shaped, "root"), "rc", F.col("ic"), zero, zero, F.col("sim"), F.col("account_evidence")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        """The parts of a bucket, one after the other."""
        out: list[tuple] = []
        pdf = pdf.sort_values("root", kind="stable")
        roots = pdf["root"].to_numpy()
        columns = [pdf[c].tolist() for c in ("batch_id", "kind", "one", "two", "at", "cents", "sim", "account")]
        ends = np.flatnonzero(np.append(roots[1:] != roots[:-1], True)) + 1
        for begin, end in zip([0, *ends[:-1]], ends):
            items: dict[str, list] = {"r": [], "i": []}
            base = {}
            for _, kind, one, two, at, cents, sim, account in zip(*(c[begin:end] for c in columns)):
                if kind == "s":
                    base[one, two] = sim, account
                else:
                    items[kind].append((at, one, cents))
            out += [(columns[0][begin], *row) for row in greedy(items["r"], items["i"], base, tol, least)]
        return pd.DataFrame(out, columns=["batch_id", "row_number", "invoice_seq", "confidence", "sim", "account", "amount"])

    if "helper" in ways or not found:
        # many small parts to a bucket: some ten thousand rows a call
        buckets = max(1, int(shape.where("way = 'helper'").agg(F.sum("rows")).first()[0] or 0) // 20_000)
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("root"), F.lit(max(buckets, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))
        found.append(rows.groupBy("bucket").applyInPandas(solve, "batch_id string, row_number long, invoice_seq long, confidence double, sim double, account boolean, amount boolean"))
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionByName(more)
    _, reason = score_columns(F.col("sim"), F.col("account"), F.col("amount"))
    return all_.select("batch_id", "row_number", "invoice_seq", "confidence", reason.alias("reason"))


def assign_by_account(requests: DataFrame, invoices: DataFrame, scores: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """``assign_one_to_one`` where ``scores`` lists pairs by account only of names alike to over ``ACCOUNT_FLOOR``.

    Pairs of other names on one account all score the same, once where amounts agree and once
    elsewhere, so they need no list: when all that scores more is paired, whatever rows of an
    account are left meet at that score, in classes of account and code.  The order is that of
    falling scores: listed pairs over the first such score, accounts by amount, listed pairs
    over the second, accounts whatever the amount.
    """
    plain = ACCOUNT_FLOOR + 0.1
    agreeing = plain + 0.05
    known = scores.select("batch_id", "r_name", "i_name", "sim").limit(0)
    left, free, found = requests, invoices, []
    for listed, least, amount in ((True, agreeing + 1e-9, None), (False, agreeing - 1e-9, True), (True, plain + 1e-9, None), (False, 0.0, False)):
        if listed:
            new = assign_one_to_one(left, free, scores, tolerance, least)
        else:
            r, i = (d.withColumn("name_key", F.lit("")) for d in (left, free))
            new = assign_one_to_one(r, i, saved(class_scores(r, i, known), "account-scores"), tolerance, least)
            named = new.join(left.select("batch_id", "row_number", F.col("name_key").alias("r_name")), ["batch_id", "row_number"]).join(free.select("batch_id", "invoice_seq", F.col("name_key").alias("i_name")), ["batch_id", "invoice_seq"])
            named = named.withColumn("sim", name_similarity(F.col("r_name"), F.col("i_name")))
            new = named.select("batch_id", "row_number", "invoice_seq", "confidence", score_columns(F.col("sim"), F.lit(True), F.lit(amount))[1].alias("reason"))
        new = saved(new, "assigned-step")
        found.append(new)
        left = saved(left.join(new.select("batch_id", "row_number"), ["batch_id", "row_number"], "left_anti"), "requests-left")
        free = saved(free.join(new.select("batch_id", "invoice_seq"), ["batch_id", "invoice_seq"], "left_anti"), "invoices-free")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def rescue_by_amount(requests: DataFrame, invoices: DataFrame, taken: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """batch_id, row_number, invoice_seq of requests whose name can't be read, by the only free invoice of their amount.

    Requests take their turn in order, so an invoice that one takes is gone for the next (see ``amounts``).
    """
    cents = lambda c: (quantize(F.col(c)) * 100).cast("long")
    r = requests.where(F.length("name_key") < 4).join(taken, ["batch_id", "row_number"], "left_anti").select("batch_id", "row_number", cents("amount").alias("rc"))
    i = invoices.join(taken, ["batch_id", "invoice_seq"], "left_anti").select("batch_id", "invoice_seq", cents("total_amount").alias("ic"))
    return only_choices(r, i, int(round(float(tolerance) * 100)))


def attach_unreadable(requests: DataFrame, unusable: DataFrame, similar: DataFrame) -> DataFrame:
    """batch_id, row_number, invoice_seq: the first invoice without a total whose name is alike; one may serve many."""
    exact = exact_name_candidates(requests, unusable).select("batch_id", F.col("name_key").alias("r_name"), F.col("name_key").alias("i_name"))
    first = unusable.groupBy("batch_id", F.col("name_key").alias("i_name")).agg(F.min("invoice_seq").alias("invoice_seq"))
    names = exact.unionByName(similar.select("batch_id", "r_name", "i_name")).join(first, ["batch_id", "i_name"]).groupBy("batch_id", F.col("r_name").alias("name_key")).agg(F.min("invoice_seq").alias("invoice_seq"))
    return requests.join(names, ["batch_id", "name_key"]).select("batch_id", "row_number", "invoice_seq")


#: Buckets of names in which payees of over ``PART_ROWS`` rows are looked for.
NAME_BUCKETS = 1 << 16


def entangled_names(requests: DataFrame, invoices: DataFrame) -> DataFrame | None:
    """batch_id, name_key of names whose rows may score 1 with rows of another name, or are too many for one task; none if there are none.

    Rows of two names score 1 if the names are alike to 0.95, or if they are on one account.
    """
    named = requests.select("batch_id", "name_key", "account_key").unionByName(invoices.select("batch_id", "name_key", "account_key")).where("name_key <> ''")
    found = []
    # accounts of one hash count as one: some names more are taken for entangled, none less
    account = named.withColumn("account", F.xxhash64("batch_id", "account_key"))
    own = account.where("account_key <> ''").select("account", F.xxhash64("name_key").alias("name"))
    mixed = saved(own.groupBy("account").agg(F.min("name").alias("least"), F.max("name").alias("most")).where("least <> most").select("account"), "mixed-accounts")
    if not mixed.isEmpty():
        found.append(account.where("account_key <> ''").join(mixed, "account", "left_semi").select("batch_id", "name_key"))
    close = similar_name_candidates(requests, invoices, BEST_NAME)
    if not close.isEmpty():
        found += [close.select("batch_id", F.col(c).alias("name_key")) for c in ("r_name", "i_name")]
    bucket = F.pmod(F.xxhash64("batch_id", "name_key"), F.lit(NAME_BUCKETS))
    full = [x["bucket"] for x in named.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART_ROWS).select("bucket").collect()]
    if full:
        found.append(named.where(bucket.isin(full)).groupBy("batch_id", "name_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART_ROWS).select("batch_id", "name_key"))
    if not found:
        return None
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = saved(out.distinct(), "entangled-names")
    released(mixed, close)
    return out


def pair_by_name(requests: DataFrame, invoices: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """The k-th request of a name with the k-th invoice of it, and what is left of both.

    batch_id, row_number, invoice_seq (one of them null in rows that are left over), name_key (of requests left
    over), account, amount (what agrees).  All rows have a name and an amount.
    """
    cents = lambda c: (quantize(F.col(c)) * 100).cast("long").alias("cents")
    row = lambda d, asks, at, amount: d.select("batch_id", "name_key", F.lit(asks).alias("asks"), F.col(at).alias("at"), cents(amount), F.when(F.col("account_key") != "", F.xxhash64("account_key")).alias("account"), F.when(F.col("code_key") != "", F.xxhash64("code_key")).alias("code"))
    rows = row(requests, True, "row_number", "amount").unionByName(row(invoices, False, "invoice_seq", "total_amount"))
    # one exchange serves ranks and pairs
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "batch_id", "name_key")
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("batch_id", "name_key", "asks").orderBy("at")))
    of = lambda asks, c: F.max(F.when(F.col("asks") == asks, F.col(c)))
    both = rows.groupBy("batch_id", "name_key", "k").agg(*(of(a, c).alias(f"{p}_{c}") for p, a in (("r", True), ("i", False)) for c in ("at", "cents", "account", "code")))
    agree = (F.col("r_account") == F.col("i_account")) & (F.col("i_code").isNull() | F.coalesce(F.col("i_code") == F.col("r_code"), F.lit(False)))
    return both.select(
        "batch_id", F.col("r_at").alias("row_number"), F.col("i_at").alias("invoice_seq"), F.when(F.col("i_at").isNull(), F.col("name_key")).alias("name_key"),
        F.coalesce(agree, F.lit(False)).alias("account"), F.coalesce(F.abs(F.col("r_cents") - F.col("i_cents")) <= int(round(float(tolerance) * 100)), F.lit(False)).alias("amount"),
    )


def assigned(requests: DataFrame, invoices: DataFrame, tolerance: str = "0.01") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The greedy one-to-one assignment of keyed rows: (pairs, requests that are left, invoices that are left).

    pairs: batch_id, row_number, invoice_seq, confidence, reason; invoices have a total.
    Pairs that score 1 come first whatever else there is, so they are made first.  Most names have nothing to do with
    another one at that score, and are paired by rank as they are; the others (see
    ``entangled_names``) are paired by class.  Similar names are only searched for what is left.
    """
    pair = ["batch_id", "row_number", "invoice_seq", "confidence", "reason"]
    tangled = entangled_names(requests, invoices)
    single = (lambda d: d) if tangled is None else (lambda d: d.join(tangled, ["batch_id", "name_key"], "left_anti"))
    ranks = saved(pair_by_name(*(single(d.where("name_key <> ''")) for d in (requests, invoices)), tolerance), "paired-by-name")
    sure = F.concat_ws(", ", F.lit("name similarity 1.00"), F.when(F.col("account"), "bank account matches"), F.when(F.col("amount"), "invoice total agrees with the requested amount"))
    found = [ranks.where("row_number IS NOT NULL AND invoice_seq IS NOT NULL").select("batch_id", "row_number", "invoice_seq", F.lit(1.0).alias("confidence"), sure.alias("reason"))]
    rest_r, rest_i = (ranks.where(f"{other} IS NULL").select("batch_id", at) for at, other in (("row_number", "invoice_seq"), ("invoice_seq", "row_number")))
    nameless = [d.where("name_key = ''") for d in (requests, invoices)]
    others = []
    if tangled is not None:
        r, i = (saved(d.join(tangled, ["batch_id", "name_key"], "left_semi"), "entangled-rows") for d in (requests, invoices))
        busy = saved(busy_accounts(r, i), "busy-accounts")
        best = saved(best_class_scores(r, i, None if busy.isEmpty() else busy), "best-scores")
        top = saved(assign_one_to_one(r, i, best, tolerance, least=1.0), "assigned-best")
        found.append(top)
        others = [r.join(top, ["batch_id", "row_number"], "left_anti"), i.join(top, ["batch_id", "invoice_seq"], "left_anti")]
        released(busy, best)
    free = [nameless[1]] + others[1:]
    over = not rest_i.isEmpty()
    if over:
        free.append(invoices.join(rest_i, ["batch_id", "invoice_seq"], "left_semi"))
    free = saved(_all(free), "invoices-free")
    if free.isEmpty():
        # nothing is left to compare with: the requests that are left need their names only
        left = [ranks.where("invoice_seq IS NULL").select("batch_id", "row_number", "name_key"), *(d.select("batch_id", "row_number", "name_key") for d in [nameless[0], *others[:1]])]
        return _all(found), _all(left), free
    left = saved(_all([requests.join(rest_r, ["batch_id", "row_number"], "left_semi"), nameless[0], *others[:1]]), "requests-left")
    busy = saved(busy_accounts(left, free), "busy-accounts")
    some = not busy.isEmpty()
    similar = similar_name_candidates(left, free)
    scores = saved(class_scores(left, free, similar, busy if some else None, ACCOUNT_FLOOR), "scores")
    assign = assign_by_account if some else assign_one_to_one
    more = saved(assign(left, free, scores, tolerance), "assigned")
    short = left.where(F.length("name_key") < 4)
    if not short.isEmpty():
        rescued = rescue_by_amount(short, free, more.select("batch_id", "row_number", "invoice_seq"), tolerance)
        more = _all([more, rescued.select("*", F.lit(0.5).alias("confidence"), F.lit(BY_AMOUNT).alias("reason"))])
        more = saved(more.select(pair), "assigned")
    released(busy, similar, scores)
    return _all([*found, more]), left.join(more, ["batch_id", "row_number"], "left_anti"), free.join(more, ["batch_id", "invoice_seq"], "left_anti")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def assigned_rows(requests: DataFrame, invoices: DataFrame, tolerance: str = "0.01") -> tuple[DataFrame, DataFrame]:
    """(pairs with a readable invoice, requests without one): batch_id, row_number and invoice_seq, confidence, reason or name_key."""
    rows = lambda d, at, amount: saved(keyed(d).select("batch_id", at, amount, "name_key", "account_key", "code_key"), "keyed")
    requests, usable = rows(requests, "row_number", "amount"), rows(split_usable(invoices)[0], "invoice_seq", "total_amount")
    chosen, left, _free = assigned(requests, usable, tolerance)
    return chosen, left.select("batch_id", "row_number", "name_key")


def attached(chosen: DataFrame, left: DataFrame, invoices: DataFrame | None = None) -> DataFrame:
    """A row for each request: the chosen pairs, and the requests that are left, with an unreadable invoice of ``invoices`` or none."""
    if invoices is None:
        held = left.withColumn("invoice_seq", F.lit(None).cast("long"))
    else:
        left = saved(left, "requests-left")
        late = saved(keyed(split_usable(invoices)[1]).select("batch_id", "invoice_seq", "name_key"), "unreadable")
        third = attach_unreadable(left, late, similar_name_candidates(left, late))
        held = left.select("batch_id", "row_number").join(third, ["batch_id", "row_number"], "left")
    reason = F.when(F.col("invoice_seq").isNull(), UNMATCHED).otherwise(UNREADABLE)
    return chosen.unionByName(held.select("batch_id", "row_number", "invoice_seq", F.lit(0.0).alias("confidence"), reason.alias("reason")))


def pairings(requests: DataFrame, invoices: DataFrame, tolerance: str = "0.01", unreadable: bool = True) -> DataFrame:
    """A row for each request: batch_id, row_number, invoice_seq, confidence, reason.

    A row without an invoice has a null invoice_seq and confidence 0.  Without ``unreadable`` the
    requests that no readable invoice supports are not looked up among the unreadable ones:
    for what is paid and what stays over, which they don't change.
    """
    return attached(*assigned_rows(requests, invoices, tolerance), invoices if unreadable else None)


def unmatched_invoices(invoices: DataFrame, pairs: DataFrame) -> DataFrame:
    """Invoices that support no request: unassigned ones, and all without a total."""
    usable, unusable = split_usable(invoices)
    used = pairs.where("invoice_seq IS NOT NULL").select("batch_id", "invoice_seq")
    return usable.join(used, ["batch_id", "invoice_seq"], "left_anti").unionByName(unusable)
