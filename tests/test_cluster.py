"""Spark operators against small specifications in plain Python."""

from __future__ import annotations

import random
from statistics import median

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.operators import cluster

WORD = "source_file string, page_number bigint, word_id bigint, text string, x0 double, y0 double, x1 double, y1 double, confidence double, source string"
LINE = "source_file string, page_number bigint, line_id bigint, start_x double, start_y double, end_x double, end_y double, thickness double, is_horizontal boolean"

boxes = st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(1, 12)), min_size=1, max_size=25)


def word_rows(items, page=1):
    return [("f", page, i, f"w{i}", float(x), float(y), float(x + 5), float(y + h), 0.5, "native") for i, (x, y, h) in enumerate(items)]


def first_fit(items, at, tolerance):
    """Line number of each word: the first line whose first word is near enough."""
    heads, out = [], {}
    for w in sorted(items, key=lambda w: (at(w), w[4], w[2])):
        k = next((k for k, h in enumerate(heads) if abs(h - at(w)) <= tolerance(w)), None)
        if k is None:
            k = len(heads)
            heads.append(at(w))
        out[w[2]] = k
    return out


@settings(max_examples=8, deadline=None)
@given(boxes)
def test_reading_order(spark, items):
    rows = word_rows(items)
    got = cluster.text_lines(spark.createDataFrame(rows, WORD), ["page_number"], 3.0).collect()
    spec = first_fit(rows, lambda w: (w[5] + w[7]) / 2, lambda w: 3.0)
    assert {r["word_id"]: r["line_no"] for r in got} == spec
    order = [r["word_id"] for r in sorted(got, key=lambda r: (r["line_no"], r["place"]))]
    assert order == [w[2] for w in sorted(rows, key=lambda w: (spec[w[2]], w[4], (w[5] + w[7]) / 2, w[2]))]


@settings(max_examples=8, deadline=None)
@given(boxes)
def test_legacy_rows(spark, items):
    rows = word_rows(items)
    got = cluster.legacy_rows(spark.createDataFrame(rows, WORD)).collect()
    assert {r["word_id"]: r["row_no"] for r in got} == first_fit(rows, lambda w: (w[5] + w[7]) / 2, lambda w: max(5.0, 0.6 * (w[7] - w[5])))


def test_top_rows_keep_their_order(spark):
    rows = word_rows([(30, 0, 5), (0, 2, 5), (10, 20, 5)])
    got = {r["word_id"]: (r["line_no"], r["place"]) for r in cluster.text_lines(spark.createDataFrame(rows, WORD), ["page_number"], 4.0, along="top").collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (1, 0)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=1, max_size=30))
def test_axis_clusters(spark, values):
    df = spark.createDataFrame([("f", 1, float(v)) for v in values], "source_file string, page_number int, v double")
    got = sorted((r["position"], r["n"]) for r in cluster.axis_clusters(df, ["source_file", "page_number"], "v", 4.0).collect())
    groups = []
    for v in sorted(values):
        if groups and v - groups[-1][-1] <= 4:
            groups[-1].append(v)
        else:
            groups.append([v])
    assert got == sorted((sum(g) / len(g), len(g)) for g in groups)


def test_page_tolerance(spark):
    df = spark.createDataFrame(word_rows([(0, 0, 1), (0, 0, 2), (0, 0, 3), (0, 0, 10)]), WORD)
    assert cluster.page_tolerance(df).first()["tolerance"] == max(1.0, median([1, 2, 3, 10]) * 0.55)


def test_merge_collinear(spark):
    flat = lambda i, x0, x1, y: ("f", 1, i, float(x0), float(y), float(x1), float(y), 1.0, True)
    df = spark.createDataFrame([flat(0, 0, 40, 10), flat(1, 42, 80, 11)], LINE)
    got = cluster.merge_collinear(df).collect()
    assert [(r["start_x"], r["end_x"], r["start_y"]) for r in got] == [(0.0, 80.0, 10.5)]
    drift = spark.createDataFrame([flat(0, 0, 10, 0), flat(1, 0, 10, 3), flat(2, 0, 10, 4.4)], LINE)
    assert [r["start_y"] for r in cluster.merge_collinear(drift).collect()] == [2.95]
    apart = spark.createDataFrame([flat(0, 0, 10, 0), flat(1, 40, 50, 0)], LINE)
    assert cluster.merge_collinear(apart).count() == 2
    assert cluster.merge_collinear(df.limit(0)).count() == 0


def test_footer_lines_take_the_latest(spark):
    rows = word_rows([(0, 0, 10), (20, 4, 10), (0, 20, 10)])
    got = {r["word_id"]: r["line_no"] for r in cluster.footer_lines(spark.createDataFrame(rows, WORD)).collect()}
    assert got == {0: 0, 1: 0, 2: 1}


def test_joined_lines(spark):
    df = spark.createDataFrame([(["Inven-", "tarski", "", "broj"],), ([],), (["a"],)], "v array<string>")
    assert [r[0] for r in df.select(cluster.joined_lines(F.col("v"))).collect()] == ["Inven-tarski broj", "", "a"]


def test_legacy_text(spark):
    rows = [(*w[:3], t, *w[4:]) for w, t in zip(word_rows([(0, 0, 10), (20, 0, 10), (0, 30, 10)]), [" Inven- ", "  ", "tarski"], strict=True)]
    df = cluster.legacy_rows(spark.createDataFrame(rows, WORD))
    assert cluster.legacy_cell_text(df, ["page_number"]).first()["text"] == "Inven-tarski"
    assert cluster.legacy_cell_text(df, ["page_number"], line_breaks=True).first()["text"] == "Inven-\ntarski"


def test_random_pages_do_not_mix(spark):
    random.seed(1)
    rows = [w for p in range(5) for w in word_rows([(random.randrange(50), random.randrange(50), 6) for _ in range(20)], p)]
    got = cluster.text_lines(spark.createDataFrame(rows, WORD), ["page_number"], 4.0).collect()
    for p in range(5):
        own = [w for w in rows if w[1] == p]
        assert {r["word_id"]: r["line_no"] for r in got if r["page_number"] == p} == first_fit(own, lambda w: (w[5] + w[7]) / 2, lambda w: 4.0)
