from __future__ import annotations

from datetime import date

from gridloom.operators import forms, grids, merge
from tests.test_cluster import LINE, WORD


def table_lines(xs, ys, page=1):
    out = [("f", page, i, float(xs[0]), float(y), float(xs[-1]), float(y), 1.0, True) for i, y in enumerate(ys)]
    return out + [("f", page, 100 + i, float(x), float(ys[0]), float(x), float(ys[-1]), 1.0, False) for i, x in enumerate(xs)]


def words_at(items, page=1):
    return [("f", page, i, t, float(x), float(y), float(x + w), float(y + 10), 1.0, "native") for i, (t, x, y, w) in enumerate(items)]


XS, YS = (0, 50, 230, 350, 400, 500, 600), (0, 30, 60)


def test_three_by_seven_lines_make_one_grid(spark):
    g = grids.detect_grids(spark.createDataFrame(table_lines(XS, YS), LINE))
    assert [(r["column_boundaries"], r["row_boundaries"]) for r in g.collect()] == [([float(x) for x in XS], [0.0, 30.0, 60.0])]
    assert grids.grid_cells(g).count() == 12
    backwards = [(*r[:3], r[5], r[6], r[3], r[4], *r[7:]) for r in table_lines(XS, YS)]
    assert grids.detect_grids(spark.createDataFrame(backwards, LINE)).count() == 1
    assert grids.detect_grids(spark.createDataFrame(table_lines(XS, YS)[:1], LINE)).count() == 0


def test_two_tables_side_by_side_are_two_grids(spark):
    left, right = table_lines((0, 50, 100), (0, 20, 40)), table_lines((300, 350, 420), (0, 20, 40))
    rows = left + [(*r[:2], r[2] + 1000, *r[3:]) for r in right]
    g = grids.detect_grids(spark.createDataFrame(rows, LINE)).orderBy("grid_id").collect()
    assert [(r["x0"], r["x1"]) for r in g] == [(300.0, 420.0), (0.0, 100.0)]


def test_words_go_to_the_cell_of_their_centre_and_ties_down_right(spark):
    g = grids.detect_grids(spark.createDataFrame(table_lines((0, 50, 100), (0, 20, 40)), LINE))
    w = words_at([("a", 10, 5, 20), ("b", 40, 5, 20), ("c", 45, 15, 10), ("d", 300, 5, 10)])
    got = {r["text"]: (r["row"], r["col"]) for r in grids.assign_words(spark.createDataFrame(w, WORD), g).collect()}
    assert got == {"a": (0, 0), "b": (0, 1), "c": (1, 1)}


def test_cell_text_and_hyphen(spark):
    g = grids.detect_grids(spark.createDataFrame(table_lines((0, 100, 200), (0, 50, 100)), LINE))
    w = words_at([("Inven-", 5, 2, 30), ("tarski", 5, 20, 30), ("broj", 40, 20, 20), ("Red", 110, 5, 20), (".", 135, 5, 4), ("broj", 145, 5, 20)])
    cells = {(r["row"], r["col"]): r["text"] for r in grids.cell_table(spark.createDataFrame(w, WORD), g).collect()}
    assert cells == {(0, 0): "Inven-tarski broj", (0, 1): "Red. broj", (1, 0): "", (1, 1): ""}


def test_scores(spark):
    page = spark.createDataFrame([("f", 1, 400.0, 300.0)], "source_file string, page_number bigint, page_width double, page_height double")

    def score(xs, ys, items):
        g = grids.detect_grids(spark.createDataFrame(table_lines(xs, ys), LINE))
        cells = grids.cell_table(spark.createDataFrame(words_at(items), WORD), g)
        return grids.grid_scores(cells, g, page).first()["score"]

    full = [(f"t{r}{c}", 20 + c * 100, 20 + r * 40, 30) for r in range(4) for c in range(3)]
    assert abs(score((10, 110, 210, 310), (10, 50, 90, 130, 170), full) - 1.0) < 1e-9
    assert score((10, 30), (10, 30), [("x", 12, 12, 5)]) == 0.0


def form_words():
    header = [("Petar", 30, 150, 40), ("Petrović", 80, 150, 50), ("0101990710012", 330, 150, 90), ("Pravna", 450, 150, 50), ("služba", 510, 150, 40),
              ("(prezime", 30, 170, 50), ("i", 85, 170, 8), ("ime)", 95, 170, 30), ("(naziv", 450, 170, 40)]
    foot = [("Zaključno", 20, 720, 60), ("sa", 85, 720, 10), ("rednim", 100, 720, 40), ("brojem:", 145, 720, 45), ("4", 195, 720, 6),
            ("Datum", 20, 740, 40), ("predaje", 65, 740, 45), ("opreme:", 115, 740, 45), ("28.", 165, 740, 15), ("08.", 182, 740, 15), ("2024", 200, 740, 25),
            ("Opremu", 20, 760, 45), ("predao", 70, 760, 40), (":", 112, 760, 3), ("Ana", 120, 760, 25), ("Opremu", 20, 780, 45), ("primio", 70, 780, 40), ("Ivo", 120, 780, 20)]
    rows = [("Red.", 20, 205, 20), ("opreme", 120, 205, 40), ("Model", 220, 205, 30), ("Kol", 320, 205, 20), ("Serijski", 420, 205, 40), ("Inventarski", 520, 205, 60),
            ("1", 20, 225, 6), ("Monitor", 120, 225, 40), ("|", 220, 225, 3), ("2", 320, 225, 6), ("S-1", 420, 225, 20), ("I-1", 520, 225, 20), ("2", 20, 245, 6)]
    return words_at(header + foot + rows)


def test_form_record(spark):
    lines = spark.createDataFrame(table_lines((10, 110, 210, 310, 410, 510, 610), (200, 220, 240, 260, 700)), LINE)
    w = spark.createDataFrame(form_words(), WORD)
    g = grids.detect_grids(lines)
    size = spark.createDataFrame([("f", 1, 620.0, 800.0)], "source_file string, page_number bigint, page_width double, page_height double")
    best = grids.form_grid(g, size)
    assert best.first()["accepted"]
    cells = grids.cell_table(w, best)
    r = forms.form_records(w, best, cells).first()
    assert (r["person_name"], r["person_identifier"], r["organization_unit"]) == ("Petar Petrović", "0101990710012", "Pravna služba")
    assert (r["closing_item_number"], r["handover_date"], r["handed_over_by"], r["received_by"]) == ("4", date(2024, 8, 28), "Ana", "Ivo")
    assert [tuple(i)[1:7] for i in r["items"]] == [("1", "Monitor", "", "2", "S-1", "I-1")]
    assert forms.header_warnings(cells).count() == 0
    match = forms.match_templates(forms.page_text(w)).first()
    assert match["accepted"] == (match["confidence"] >= 0.55)


def test_template_and_captions_only(spark):
    text = "REVERS\ndole navedena oprema Red . broj Vrsta računarske opreme Model Kol Serijski broj Inventar ski broj"
    page = spark.createDataFrame([("f", 1, text)], "source_file string, page_number bigint, text string")
    m = forms.match_templates(page).first()
    assert m["accepted"] and len(m["matched_anchors"]) == 8 and abs(m["confidence"] - (8 / 12 + 0.30)) < 1e-9
    g = grids.detect_grids(spark.createDataFrame(table_lines((10, 310, 610), (200, 220, 700)), LINE))
    captions = [w for w in form_words() if "prezime" in w[3] or "ime)" in w[3] or "naziv" in w[3]]
    assert forms.header_fields(spark.createDataFrame(captions, WORD), g).count() == 0


def test_merge(spark):
    base = [("f", 1, 0, "Model", 0.0, 0.0, 50.0, 10.0, 0.5, "native"), ("f", 1, 1, "Serija", 100.0, 0.0, 150.0, 10.0, 0.9, "native")]
    ocr = [("f", 1, 10, "MODEL", 1.0, 0.0, 50.0, 10.0, 0.9, "ocr"), ("f", 1, 11, "zzzz", 100.0, 0.0, 150.0, 10.0, 0.99, "ocr"), ("f", 1, 12, "novo", 300.0, 0.0, 350.0, 10.0, 0.4, "ocr")]
    merged, doubts = merge.merge_words(spark.createDataFrame(base + ocr, WORD))
    assert [r["text"] for r in merged.orderBy("position").collect()] == ["Model", "zzzz", "novo"]
    assert [(r["field_value"], r["code"]) for r in doubts.collect()] == [("zzzz", "NATIVE_OCR_DISAGREEMENT")]
    weaker = [(*r[:8], 0.1, r[9]) if r[2] == 11 else r for r in ocr]
    kept, again = merge.merge_words(spark.createDataFrame(base + weaker, WORD))
    assert [r["text"] for r in kept.orderBy("position").collect()] == ["Model", "Serija", "novo"] and again.count() == 1


def test_words_without_a_box(spark):
    rows = [("f", 1, 0, "a", None, 0.0, 5.0, 5.0, None, "native"), ("f", 1, 1, "b", 0.0, 0.0, 5.0, 5.0, 0.9, "ocr"), ("f", 1, 2, None, 0.0, 0.0, 5.0, 5.0, 0.1, "ocr")]
    merged, doubts = merge.merge_words(spark.createDataFrame(rows, WORD))
    assert [r["word_id"] for r in merged.orderBy("position").collect()] == [0, 1] and doubts.count() == 1
    from gridloom.operators import cluster

    lines = cluster.text_lines(spark.createDataFrame(rows, WORD), ["page_number"], 3.0).collect()
    assert {r["word_id"]: r["line_no"] for r in lines} == {1: 0, 2: 0}
    g = grids.detect_grids(spark.createDataFrame(table_lines((0, 50, 100), (0, 20, 40)), LINE))
    assert grids.assign_words(spark.createDataFrame(rows, WORD), g).count() == 2
