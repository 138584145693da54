from __future__ import annotations

from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import text as T


def values(spark, expr, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize(spark):
    assert values(spark, T.normalize_text, ["  a \t b ", "š\x00", "Ћи  р\nb", None, ""]) == ["a b", "š", "Ћи р\nb", None, ""]


def test_form_text(spark):
    assert values(spark, T.normalize_form_text, ["Inventar\nski  BROJ", "RED . BROJ:", "(Straße)", "ﬁ"]) == ["inventarski broj", "red. broj", "strasse", "fi"]


def test_inferred(spark):
    got = values(spark, T.inferred, ["12", "-3", "0641234567", "0", "1,5", "01.02.2026", "5.1.2026", "5/1/2026", "2026-1-5", "31.02.2026", "x", " ", None, "9" * 19])
    kinds = [g["kind"] for g in got]
    assert kinds == ["int", "int", "text", "int", "float", "text", "date", "date", "date", "text", "text", "text", None, "text"]
    assert got[0]["i"] == 12 and got[4]["d"] == 1.5 and got[6]["t"] == datetime(2026, 1, 5) and got[2]["s"] == "0641234567"


def test_formula_guard(spark):
    assert values(spark, T.formula_safe, ["=cmd()", " +1", "a=b", "-x", "@y", None]) == ["'=cmd()", "' +1", "a=b", "'-x", "'@y", None]


def test_dates(spark):
    assert values(spark, T.day_month_year, ["28 | 08 | 2026", "31.02.2026", "x 1/2/2024.", "112.1.2024", None]) == [date(2026, 8, 28), None, date(2024, 2, 1), None, None]


def test_value_after(spark):
    assert values(spark, lambda c: T.value_after(c, r"opremu\s+primio"), ["Opremu  primio :_ Ana |", "Opremu predao Ana", "OPREMU PRIMIO"]) == ["Ana", "", ""]


@pytest.mark.parametrize(("text", "artifact"), [("|", True), ("||", True), ("_", True), ("__", True), ("__|", True), ("|I", True), ("-12", False), ("AB-12", False), ("", False)])
def test_artifacts(spark, text, artifact):
    df = spark.createDataFrame([(text, 0.9)], "v string, c double")
    assert df.select(T.is_rule_artifact(F.col("v"), F.col("c"))).first()[0] is artifact


def test_paths_and_labels(spark):
    assert values(spark, T.default_output, ["a.pdf", "a.b.PDF", "a"]) == ["a.xlsx", "a.b.xlsx", "a.xlsx"]
    assert values(spark, T.is_label, ["(prezime", "Ime", "Marko"]) == [True, True, False]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet=" \t ab-0.=", max_size=8), min_size=1, max_size=20))
def test_strip_like_python(spark, items):
    assert values(spark, T.strip, items) == [x.strip() for x in items]


def test_similarity(spark):
    df = spark.createDataFrame([("Model", "MODEL"), ("abcd", "bcde"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(T.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.75, None]
