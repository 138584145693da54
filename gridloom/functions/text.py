"""Text, type and date rules as Column expressions.

Pattern classes are Unicode (``(?U)``), so they agree with what people see and not
with ASCII. Only normal forms, full case folding and sequence similarity need Python,
where they run on Arrow batches.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Signs that OCR reads from table rules.
RULE_SIGNS = "|_—–.\\-·"
#: Parts of words that mark a caption rather than a value.
LABEL_PARTS = ("prezime", "ime", "naziv", "organizacione", "jedinice")
#: Date notations, day first but for the last.
DATE_FORMATS = ("d.M.yyyy", "d/M/yyyy", "yyyy-M-d")


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))


@F.pandas_udf(StringType())
def _nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x.casefold(), y.casefold()).ratio() for x, y in zip(a, b, strict=True)])


def strip(col: Column) -> Column:
    """Blanks of every kind off both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def is_blank(col: Column) -> Column:
    return ~F.coalesce(col, F.lit("")).rlike(r"(?U)\S")


def normalize_text(col: Column) -> Column:
    """Composed characters, no NUL, one blank for runs of blanks and tabs; line breaks inside stay."""
    return strip(F.regexp_replace(_nfc(F.replace(col, F.lit("\x00"), F.lit(""))), r"[ \t]+", " "))


def normalize_form_text(col: Column) -> Column:
    """Compatibility form, case folded, split captions joined, anything but words and points a blank."""
    folded = _nfkc_casefold(col)
    joined = F.regexp_replace(F.regexp_replace(folded, r"(?U)inventar\s*ski", "inventarski"), r"(?U)red\s*\.\s*broj", "red. broj")
    return strip(F.regexp_replace(joined, r"(?U)[^\w.]+", " "))


def similarity(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of the case-folded strings, 0 to 1."""
    return _similarity(a, b)


def has_alphanumeric(col: Column) -> Column:
    return F.coalesce(col, F.lit("")).rlike(r"[\p{L}\p{N}]")


def inferred(col: Column) -> Column:
    """The value with its type: ``struct<kind,i,d,t,s>``.

    Text that starts with 0 stays text, but for a lone 0; so does an integer of more
    than 18 digits, which no column type holds exactly.
    """
    v = strip(col)
    keep = (v == "") | (v.startswith("0") & (F.length(v) > 1))
    whole = ~keep & v.rlike(r"^[-+]?[0-9]{1,18}$")
    broken = ~keep & v.rlike(r"^[-+]?[0-9]+[.,][0-9]+$")
    stamp = F.coalesce(*(F.expr("null").cast("timestamp_ntz"), *(F.try_to_timestamp(v, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS)))
    dated = ~keep & ~whole & ~broken & v.rlike(r"^[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}$") & stamp.isNotNull()
    kind = F.when(col.isNull(), F.lit(None)).when(whole, "int").when(broken, "float").when(dated, "date").otherwise("text")
    return F.struct(
        kind.alias("kind"),
        F.when(whole, v.try_cast("bigint")).alias("i"),
        F.when(broken, F.replace(v, F.lit(","), F.lit(".")).try_cast("double")).alias("d"),
        F.when(dated, stamp).alias("t"),
        F.when(kind == "text", v).alias("s"),
    )


def formula_safe(col: Column) -> Column:
    """Text that a spreadsheet would read as a formula gets an apostrophe."""
    return F.when(col.rlike(r"(?U)^\s*[=+\-@]"), F.concat(F.lit("'"), col)).otherwise(col)


def export_value(col: Column) -> Column:
    """Inferred, and formula safe where it stays text."""
    v = inferred(col)
    return v.withField("s", formula_safe(v["s"]))


def day_month_year(col: Column) -> Column:
    """The first date written day, month, year with any of the usual separators; null if there is no such day."""
    pattern = r"(?<![0-9])([0-9]{1,2})\s*[./|\- ]\s*([0-9]{1,2})\s*[./|\- ]\s*([0-9]{4})(?![0-9])"
    part = lambda k: F.regexp_extract(col, pattern, k)
    text = F.when(part(1) != "", F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")))
    return text.try_cast("date")


def value_after(col: Column, label: str) -> Column:
    """What follows a label and an optional colon; empty without the label."""
    rest = F.regexp_extract(col, rf"(?isU)^.*?(?:{label})\s*[:：]?\s*(.*)$", 1)
    return F.regexp_replace(rest, r"^[ _|:：]+|[ _|:：]+$", "")


def is_rule_artifact(text: Column, confidence: Column, touches_border: Column | bool = True) -> Column:
    """Whether a cell's text is what OCR made of table rules."""
    v = strip(F.coalesce(text, F.lit("")))
    touches = touches_border if isinstance(touches_border, Column) else F.lit(touches_border)
    share = F.length(F.regexp_replace(v, f"[^{RULE_SIGNS}]", "")) / F.greatest(F.length(v), F.lit(1))
    unsure = lambda limit: confidence.isNull() | (confidence < limit)
    return (
        F.when(v == "", False)
        .when(v.rlike(rf"(?U)^[\s{RULE_SIGNS}]+$"), True)
        .when(v.isin("|I", "I|", "||I", "I||"), touches | unsure(0.75))
        .otherwise(touches & (share >= 0.7) & unsure(0.6))
    )


def is_label(col: Column) -> Column:
    low = F.lower(col)
    return F.exists(F.array(*(F.lit(p) for p in LABEL_PARTS)), lambda p: F.contains(low, p))


def default_output(path: Column) -> Column:
    return F.regexp_replace(path, r"^(.*?)(\.[^./\\]*)?$", "$1.xlsx")
