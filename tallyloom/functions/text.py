"""Names, ids and script variants, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short forms of company words, in the order of replacement.
SHORT_FORMS = (("limited", "ltd"), ("company", "co"), ("corporation", "corp"), ("incorporated", "inc"))
# Full-width forms, and traditional characters with their simplified ones.
WIDE = "０１２３４５６７８９．，：（）號碼賬帳銀編總計"
NARROW = "0123456789.,:()号码账帐银编总计"
#: Least size of a text layer, and of its alphabet.
LAYER_CHARS, LAYER_ALPHABET = 60, 8


def normalise_name(name: Column) -> Column:
    """Lower case, letters, digits and underscores only, company words shortened; empty for null."""
    out = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}_]+", "")
    for long, short in SHORT_FORMS:
        out = F.replace(out, F.lit(long), F.lit(short))
    return out


def normalise_digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9]", "")


def bank_id(code: Column, account: Column) -> Column:
    """code-account, or the one that is there, or empty."""
    return F.concat_ws("-", F.nullif(F.trim(code), F.lit("")), F.nullif(F.trim(account), F.lit("")))


def fold_text(text: Column) -> Column:
    """Full-width digits and marks, and some traditional characters, to their plain forms."""
    return F.translate(text, WIDE, NARROW)


def is_text_layer(text: Column, min_chars: int = LAYER_CHARS) -> Column:
    """Is there enough text, of enough different characters, to do without OCR?"""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")
    return (F.length(bare) >= min_chars) & (F.size(F.array_distinct(F.split(bare, ""))) > LAYER_ALPHABET)


def choose_text(layer: Column, ocr: Column, vision: Column, force_ocr: Column | None = None, allow_vision: Column | None = None) -> Column:
    """struct<text, source_kind, warnings>: the text layer if it will do, else OCR, else vision, else nothing.

    The note that there is no text layer goes where OCR made up for it.
    """
    forced = F.lit(False) if force_ocr is None else force_ocr
    allowed = F.lit(True) if allow_vision is None else allow_vision
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    use_layer = ~forced & is_text_layer(layer)
    use_ocr, use_vision = ~use_layer & filled(ocr), ~use_layer & ~filled(ocr) & allowed & filled(vision)
    none = F.lit("No usable text layer found; document is a scan, OCR required.")
    note = F.when(forced, "Text layer skipped (OCR forced).").when(~use_layer & ~use_ocr, none)
    return F.struct(
        F.when(use_layer, layer).when(use_ocr, ocr).when(use_vision, vision).otherwise("").alias("text"),
        F.when(use_layer, "TEXT_LAYER").when(use_ocr, "OCR_LOCAL").when(use_vision, "OCR_VISION").otherwise("NONE").alias("source_kind"),
        F.array_compact(F.array(note)).alias("warnings"),
    )
