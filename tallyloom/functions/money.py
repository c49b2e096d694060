"""Amounts in text and cells, as column functions.  Money is decimal throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CENTS = "decimal(18,2)"

# What counts as a currency, a total line and a subtotal line.
CURRENCY = r"HKD|HK\$|USD|CNY|RMB|EUR|\$|¥|￥"
TOTAL_CUE = r"[總总]\s*[計计]|合\s*[計计]|[總总]\s*[額额]|[應应]\s*付|total\s+amount|grand\s+total|amount\s+due|total\s+due|balance\s+due|total"
SUBTOTAL_CUE = r"sub\s*-?\s*total|小\s*[計计]"

_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]*"
# Fixed value: what a money token looks like; group 1 is the currency, group 2 the number.
AMOUNT = rf"(?i)({CURRENCY})?{_SPACE}([0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\.[0-9]{{1,2}})?|[0-9]+\.[0-9]{{1,2}}|[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+(?:\.[0-9]+)?)(?![0-9.])"
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x85  ]"


def to_decimal(text: Column) -> Column:
    """A cell's amount with six places: commas, white space and a leading currency dropped; null where no number is left."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[,\s\p{Z}]", ""), r"^[^0-9.+\-]+", "")
    return bare.try_cast("decimal(18,6)")


def quantize(amount: Column) -> Column:
    """Half-up cents."""
    return F.round(amount, 2).cast(CENTS)


def amounts_equal(left: Column, right: Column, tolerance: str = "0.01") -> Column:
    return F.abs(quantize(left) - quantize(right)) <= F.lit(tolerance).cast(CENTS)


def format_amount(amount: Column) -> Column:
    """120000.00; empty for null."""
    return F.coalesce(quantize(amount).cast("string"), F.lit(""))


def format_amount_display(amount: Column) -> Column:
    """120,000.00; empty for null."""
    return F.coalesce(F.format_number(quantize(amount), 2), F.lit(""))


def repair_ocr_numbers(text: Column) -> Column:
    """Letter O read for a zero, and a point read for a thousands comma, inside numbers only.

    An O counts as a zero before a digit, point or comma of its number, or at the end of a
    number that has a point.  An O that stands over 40 characters behind the last digit (or
    point, at an end) stays.
    """
    # cheap conditions come first: most texts hold no such O, and most Os have no number in front
    at = r"(?=[Oo])(?<=[0-9.,Oo])"
    inner = F.regexp_replace(text, at + r"(?<=[0-9][0-9.,Oo]{0,40})[Oo](?=[Oo]*[0-9.,])", "0")
    tail = F.regexp_replace(inner, at + r"(?=[Oo]+(?![0-9.,Oo]))(?<=[0-9][0-9.,Oo]{0,40}[.][0-9.,Oo]{0,40})[Oo]", "0")
    repaired = F.when(F.rlike(text, F.lit("[0-9][.,]*[Oo]")), tail).otherwise(text)
    return F.regexp_replace(repaired, r"(?U)\b([0-9]{1,3})\.([0-9]{3})\.([0-9]{2})\b", "$1,$2.$3")


def classify_amount(number: Column, currency: Column) -> Column:
    """The amount of a matched number, or null where nothing marks it as money.

    A point, a comma or a currency marks money.  Not money: six digits or more without point
    and currency (commas left out), over two decimals, over twelve digits before a point.
    """
    digits = F.replace(number, F.lit(","), F.lit(""))
    has_point, marked = F.contains(number, F.lit(".")), currency != ""
    whole = F.substring_index(digits, ".", 1)
    places = F.length(F.substring_index(digits, ".", -1))
    noise = ~has_point & ~marked & (F.length(digits) >= 6)
    bare = ~has_point & ~marked & ~F.contains(number, F.lit(","))
    odd = has_point & ((places > 2) | (F.length(whole) > 12))
    return F.when(~(noise | bare | odd), digits.try_cast(CENTS))


def find_amounts(text: Column) -> Column:
    """array<struct<amount, token, has_currency>> in reading order, after OCR repair."""
    # one pass over the text; a token's number begins at its first digit, and its currency stands at its head
    tokens = F.regexp_extract_all(repair_ocr_numbers(text), F.lit(AMOUNT), F.lit(0))

    def read(token: Column) -> Column:
        currency = F.regexp_extract(token, f"(?i)^(?:{CURRENCY})", 0)
        amount = classify_amount(F.regexp_extract(token, "[0-9].*", 0), currency)
        return F.struct(amount.alias("amount"), F.trim(token).alias("token"), (currency != "").alias("has_currency"))

    # a token that is bare digits is no amount, whatever their number
    shown = F.filter(tokens, lambda t: F.rlike(t, F.lit(r"[^0-9\s\p{Z}\x1c-\x1f\x85]")))
    return F.filter(F.transform(shown, read), lambda r: r["amount"].isNotNull())


def amount_values(text: Column) -> Column:
    return F.transform(find_amounts(text), lambda r: r["amount"])


def extract_total(text: Column) -> Column:
    """Payable total: the last amount of the lines with a total cue, else the largest of the text, else null.

    Subtotal lines don't count.  Both Chinese scripts are accepted.  A null text gives null.
    """
    lines = F.split(text, LINE_BREAK)
    total_lines = F.filter(lines, lambda x: F.rlike(x, F.lit(f"(?i){TOTAL_CUE}")) & ~F.rlike(x, F.lit(f"(?i){SUBTOTAL_CUE}")))
    on_lines = F.flatten(F.transform(total_lines, amount_values))
    return quantize(F.coalesce(F.try_element_at(on_lines, F.lit(-1)), F.array_max(amount_values(text))))
