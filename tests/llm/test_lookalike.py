from __future__ import annotations

import unicodedata

from gridloom.llm import lookalike
from gridloom.llm.folding import consistent

SCHEMA = "word_id bigint, text string, value string, look string"


def run(spark, values, latin_only=False):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in enumerate(values)], SCHEMA)
    return {r["row_id"]: r["canonical"] for r in lookalike.inconsistent_rows(df, "word_id", "text", latin_only).collect()}


HONEST = ["Monitor", "штампач", "USB-кабл", "α-тест", "m²", "½", "№", "™", "—", "„a“", "Café", "СТО", "20°C", "", None, " ", "a\tb\nc"]


def test_honest_values_are_no_cases(spark):
    assert run(spark, HONEST) == {}


def test_disguises(spark):
    cases = {
        "Mоdel": "Model", "RΕVΕRS": "REVERS", "Ｆｉｌ．": "Fil.", "8𝟎0": "800", "MATRIČNI": "MATRIČNI", "ǈubomir": "Ljubomir", "Ðorđe": "Đorđe",
        "or​ga­n": "organ", "a b": "a b", "SN‑1": "SN-1", "INV−2": "INV-2", "Стoни": "Стони", "orɡan": "organ", "﻿x": "x", "Ⅳ": "IV",
    }
    got = run(spark, list(cases))
    assert {k: got.get(i) for i, k in enumerate(cases)} == cases


def test_serial_numbers_are_latin(spark):
    assert run(spark, ["5АD10I1WFK", "СТО", "1 и 2", "10KT"], latin_only=True) == {0: "5AD10I1WFK", 1: "CTO"}


def test_class_without_clean_member_and_ties(spark):
    composed = run(spark, ["Žužа", "Žuža", "Žužа"])
    assert set(composed.values()) == {"Žuža"} and len(composed) == 3


def test_agrees_with_python(spark):
    pool = [unicodedata.normalize(f, w) for f in ("NFC", "NFD") for w in ("Škorišić", "Љиљана", "ＡＢ１２", "Тｅst", "ﬁeld", "x y", "Ελλάδα", "Еλ")]
    got = run(spark, pool)
    assert got == {i: consistent(w) for i, w in enumerate(pool) if consistent(w) != w}


def test_long_and_empty(spark):
    long = "Mоdel " * 20_000
    assert run(spark, [long]) == {0: "Model " * 20_000}
    empty = spark.createDataFrame([], SCHEMA)
    assert lookalike.inconsistent_rows(empty, "word_id", "text").count() == 0
