"""Visually identical text written with different characters.

Look-alikes are mapped by SQL expressions, the mapped values are grouped under
the accent-sensitive collation UNICODE (which already equates composed and
combining accents and passes over invisible characters), one deterministic
member of each class becomes its canonical form, and rows get it by a join.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of two scripts that look alike, from the Unicode list of confusables.
CYRILLIC_AS_LATIN = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ԍ": "G",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I", "ѵ": "v", "Ѵ": "V", "ү": "y",
}
GREEK_AS_LATIN = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "ω": "w", "η": "n", "τ": "t",
}
#: Letters of the Latin script itself that pass for ordinary ones.
LATIN_AS_LATIN = {
    "ɡ": "g", "ɑ": "a", "ı": "i", "ȷ": "j", "ʋ": "v", "ɩ": "i", "ſ": "s", "ʟ": "L", "ɪ": "I", "ɴ": "N",
    "Ð": "Đ", "Ɖ": "Đ", "ð": "đ", "ɖ": "đ", "ᴠ": "v", "ᴢ": "z", "ᴏ": "o", "ᴡ": "w", "ꜱ": "s", "ɢ": "G", "ʀ": "R",
    "ʏ": "Y", "ʙ": "B", "ʜ": "H",
}
#: Latin letters without a twin of their own script that a Cyrillic run may have borrowed.
LATIN_AS_CYRILLIC = {
    "A": "А", "B": "В", "E": "Е", "S": "Ѕ", "I": "І", "J": "Ј", "K": "К", "M": "М", "H": "Н", "O": "О", "P": "Р",
    "C": "С", "T": "Т", "Y": "У", "X": "Х", "a": "а", "e": "е", "s": "ѕ", "i": "і", "j": "ј", "o": "о", "p": "р",
    "c": "с", "y": "у", "x": "х",
}
GREEK_AS_CYRILLIC = {g: LATIN_AS_CYRILLIC[l] for g, l in GREEK_AS_LATIN.items() if l in LATIN_AS_CYRILLIC}
LATIN_AS_GREEK = {l: g for g, l in GREEK_AS_LATIN.items() if g not in "ϲϳϹ"}
CYRILLIC_AS_GREEK = {c: LATIN_AS_GREEK[l] for c, l in CYRILLIC_AS_LATIN.items() if l in LATIN_AS_GREEK}

#: Signs that pass for the ordinary hyphen; dashes look different and stay.
HYPHENS = "‐‑−˗﹣－"
#: Invisible characters: format controls, soft hyphen, joiners, variation selectors, Hangul fillers.
INVISIBLE = r"[\p{Cf}\x{034f}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{3164}\x{fe00}-\x{fe0f}\x{ffa0}]"
#: Notations whose characters look unlike plain text and therefore are ordinary.
VISIBLY_OTHER = {"<super>", "<sub>", "<fraction>", "<circle>", "<square>"}


@lru_cache(maxsize=1)
def notation_variants() -> tuple[dict[str, str], dict[str, str]]:
    """By rule from the Unicode data: variants of one character, and of several.

    Taken are characters whose compatibility decomposition serves layout or another
    notation: wide, narrow, small, vertical and positional forms, mathematical fonts,
    blanks, and of the <compat> ones only letters and letter numbers (ligatures,
    digraphs, Roman numerals).
    """
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    for block in (range(0xA0, 0x3100), range(0xFB00, 0x10000), range(0x1D400, 0x1D800), range(0x1EE00, 0x1EF00)):
        for code in block:
            c = chr(code)
            tag = unicodedata.decomposition(c).split(" ", 1)[0]
            if not tag.startswith("<") or tag in VISIBLY_OTHER:
                continue
            kind, plain = unicodedata.category(c), unicodedata.normalize("NFKC", c)
            if kind == "Zs" or c in HYPHENS or plain == c or (tag == "<compat>" and kind[0] != "L" and kind != "Nl"):
                continue
            if tag == "<noBreak>" or kind == "Mn":
                continue
            (single if len(plain) == 1 else several)[c] = plain
    return single, several


def _translate(col: Column, table: dict[str, str]) -> Column:
    return F.translate(col, "".join(table), "".join(table.values()))


@lru_cache(maxsize=1)
def _composites() -> str:
    """``base+mark:composed`` pairs of the scripts in use, by rule, for str_to_map."""
    pairs = {}
    for block in (range(0xC0, 0x250), range(0x374, 0x530), range(0x1E00, 0x2000)):
        for code in block:
            c = chr(code)
            parts = unicodedata.normalize("NFD", c)
            if len(parts) > 1 and unicodedata.normalize("NFC", parts) == c:
                pairs[parts] = c
    return "\x01".join(f"{k}\x02{v}" for k, v in pairs.items())


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _looked_up(col: Column, pattern: str, table: str) -> Column:
    """Every match of ``pattern`` replaced by its entry in a ``str_to_map`` text, if it has one."""
    entries = F.expr(f"str_to_map('{table}', '\x01', '\x02')")
    parts = F.regexp_extract_all(col, F.lit(pattern), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(entries, x), x)), "")


def compose(col: Column) -> Column:
    """Combining accents joined with their letter, where one composed letter exists."""
    return let(col, lambda v: F.when(v.rlike(r"\p{M}"), _looked_up(v, r"(?s)(\P{M}\p{M}*|\p{M}+)", _composites())).otherwise(v))


_RUN = r"(?s)([\p{L}\p{M}]+|[^\p{L}\p{M}]+)"


def one_script(run: Column, latin_only: bool) -> Column:
    """An unbroken run of letters in one script.

    The script is the one of letters that have no twin elsewhere; if all have,
    the one with the most letters, and Latin between equals. ``latin_only`` takes
    Latin wherever every letter has a Latin twin.
    """
    latin, cyrillic, greek = (run.rlike(rf"\p{{Is{s}}}") for s in ("Latin", "Cyrillic", "Greek"))
    to_latin = _translate(run, CYRILLIC_AS_LATIN | GREEK_AS_LATIN)
    to_cyrillic = _translate(run, LATIN_AS_CYRILLIC | GREEK_AS_CYRILLIC)
    to_greek = _translate(run, LATIN_AS_GREEK | CYRILLIC_AS_GREEK)
    other = lambda col, *scripts: col.rlike("[" + "".join(rf"\p{{Is{s}}}" for s in scripts) + "]")
    can_latin, can_cyrillic, can_greek = (
        ~other(to_latin, "Cyrillic", "Greek"),
        ~other(to_cyrillic, "Latin", "Greek"),
        ~other(to_greek, "Latin", "Cyrillic"),
    )
    letters = lambda s: F.length(F.regexp_replace(run, rf"\P{{Is{s}}}", ""))
    mixed = (latin & cyrillic) | (latin & greek) | (cyrillic & greek)
    resolved = (
        F.when(can_latin & can_cyrillic, F.when(letters("Cyrillic") > letters("Latin") + letters("Greek"), to_cyrillic).otherwise(to_latin))
        .when(can_latin, to_latin)
        .when(can_cyrillic, to_cyrillic)
        .when(can_greek, to_greek)
        .otherwise(run)
    )
    if latin_only:
        return F.when(can_latin, to_latin).when(mixed, resolved).otherwise(run)
    return F.when(mixed, resolved).otherwise(run)


def look_alike_map(value: Column, latin_only: bool = False) -> Column:
    """The value with every look-alike replaced; ASCII passes through untouched."""
    single, several = notation_variants()

    def expand(v: Column) -> Column:
        table = "\x01".join(f"{k}\x02{p}" for k, p in several.items())
        return F.when(v.rlike("[" + "".join(several) + "]"), _looked_up(v, r"(?s)(.)", table)).otherwise(v)

    def unmix(v: Column) -> Column:
        runs = F.transform(
            F.regexp_extract_all(v, F.lit(_RUN), F.lit(1)), lambda r: F.when(r.rlike(r"[^\x00-\x7f]"), one_script(r, latin_only)).otherwise(r)
        )
        return F.when(v.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"), F.array_join(runs, "")).otherwise(v)

    v = F.regexp_replace(F.regexp_replace(value, INVISIBLE, ""), r"\p{Zs}", " ")
    v = _translate(F.regexp_replace(v, f"[{HYPHENS}]", "-"), single)
    v = let(compose(_translate(let(v, expand), LATIN_AS_LATIN)), unmix)
    return F.when(value.rlike(r"[^\x00-\x7f]"), v).otherwise(value)


def canonical_classes(values: DataFrame, latin_only: bool = False) -> DataFrame:
    """Classes of look-alike values: ``canonical, n_members`` beside each row of ``values``.

    ``values`` has distinct strings as ``value``. The canonical form of a class is the
    smallest member by code point that is its own look-alike mapping; a class without
    such a member takes its smallest mapping. Ties cannot remain.
    """
    mapped = values.withColumn("mapped", look_alike_map(F.col("value"), latin_only))
    return values.sparkSession.sql(
        """
        WITH keyed AS (SELECT *, mapped COLLATE UNICODE AS look FROM {mapped}),
        chosen AS (
          SELECT look, coalesce(min(CASE WHEN value = mapped THEN value END), min(mapped)) AS canonical, count(*) AS n_members
          FROM keyed GROUP BY look)
        SELECT k.* EXCEPT (mapped, look), c.canonical, c.n_members FROM keyed k JOIN chosen c ON k.look = c.look""",
        mapped=mapped,
    )


def inconsistent_rows(df: DataFrame, row_id: str, field: str, latin_only: bool = False, salts: int = 8) -> DataFrame:
    """Rows whose value is not in consistent form: ``field_name, row_id, value, canonical``.

    Null, empty and blank values are consistent; very long values are mapped whole;
    repeated rows are reported each under its own id; an empty table gives no rows,
    and other columns are ignored whatever their names.

    Scale: values are made distinct with a combine before the shuffle, so a value
    with a third of all rows is one row from then on. Pure ASCII values are their own
    form, may be the canonical member of a class, and need no second look. Only values
    that change go back to rows, each to ``salts`` tasks among which its rows are
    spread, so a hot one is not one task; a task that is still too large is split by
    the engine.
    """
    rows = df.select(F.col(f"`{row_id}`").alias("row_id"), F.col(f"`{field}`").alias("value")).where(F.col("value").isNotNull())
    changed = canonical_classes(rows.select("value").distinct(), latin_only).where(F.col("value") != F.col("canonical"))
    spread = changed.select("value", "canonical", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    able = rows.where(F.col("value").rlike(r"[^\x00-\x7f]")).withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int"))
    return able.join(spread, ["value", "_salt"]).select(F.lit(field).alias("field_name"), "row_id", "value", "canonical")


def p3_found(words: DataFrame, equipment: DataFrame, forms: DataFrame) -> DataFrame:
    parts = (
        inconsistent_rows(words, "word_id", "text"),
        inconsistent_rows(equipment, "item_id", "serial_number", latin_only=True),
        inconsistent_rows(forms, "form_id", "person_name"),
    )
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("field_name", F.col("row_id").cast("bigint").alias("row_id"))
