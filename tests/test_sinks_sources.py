from __future__ import annotations

import re
import zipfile
import zlib
from datetime import date
from pathlib import Path

import numpy as np
import pytest

from gridloom.functions import imaging
from gridloom.plans import routing
from gridloom.sinks import xlsx
from gridloom.sources import ocr, pdf, raster
from gridloom.streaming import ingest


def read(path: Path) -> dict[str, list[list[str]]]:
    with zipfile.ZipFile(path) as z:
        names = re.findall(r'<sheet name="([^"]+)"', z.read("xl/workbook.xml").decode())
        return {
            n: [re.findall(r"<t[^>]*>([^<]*)</t>|<v>([^<]*)</v>", row) for row in re.findall(r"<row[^>]*>(.*?)</row>", z.read(f"xl/worksheets/sheet{i}.xml").decode())]
            for i, n in enumerate(names, 1)
        }


def test_workbook(tmp_path):
    target = tmp_path / "a" / "revers.xlsx"
    first = xlsx.write_workbook([xlsx.Sheet("T" * 40, [["a<b", 1, None, date(2024, 1, 2)]], ["h1", "h2"]), xlsx.Sheet("T" * 40, [])], target)
    second = xlsx.write_workbook([], target)
    assert (first.name, second.name) == ("revers.xlsx", "revers (1).xlsx")
    sheets = read(first)
    assert list(sheets) == ["T" * 31, "T" * 27 + " (2)"]
    assert sheets["T" * 31][1] == [("a&lt;b", ""), ("", "1"), ("", "45293.0")]
    assert list(read(second)) == [xlsx.EMPTY_SHEET]
    assert not [p for p in target.parent.iterdir() if p.name.startswith("tmp")]


def test_titles_and_widths():
    assert xlsx.unique_title(["A", "A (2)"], "A") == "A (3)"
    assert [xlsx.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert [xlsx.column_width(n) for n in (1, 20, 100)] == [10, 22, 60]


def test_structured_sheets(spark, tmp_path):
    forms = spark.createDataFrame(
        [("a.pdf", 1, "=Ana", "012", "U", date(2024, 1, 2), "P", "R")],
        "source_file string, page_number bigint, person_name string, person_identifier string, organization_unit string, handover_date date, handed_over_by string, received_by string",
    )
    item = "source_file string, page_number bigint, item_number string, equipment_type string, model string, quantity string, serial_number string, inventory_number string, confidence double"
    items = spark.createDataFrame([("a.pdf", 1, "1", "Monitor", "", "1", "0012", "", 0.9)], item)
    warn = spark.createDataFrame(
        [("a.pdf", 1, None, "f", "v", None, None, "C", "info", "m")],
        "source_file string, page_number bigint, row_no int, field_name string, field_value string, confidence double, source string, code string, severity string, message string",
    )
    sheets = read(xlsx.write_workbook(xlsx.structured_sheets(forms, items, warn), tmp_path / "s.xlsx"))
    assert list(sheets) == ["Oprema", "Dokument", "Pregled"]
    assert len(sheets["Oprema"][0]) == 15 and sheets["Oprema"][1][2] == ("'=Ana", "")
    assert ("0012", "") in sheets["Oprema"][1]


def small_pdf(pages: int = 1) -> bytes:
    content = b"0.5 w 72 700 m 500 700 l S 72 600 100 50 re S BT /F1 12 Tf 80 705 Td (Red. broj) Tj 0 -20 Td (Mo\\(1\\)) Tj ET"
    body = zlib.compress(content)
    objs = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /MediaBox [0 0 595 842] /Count %d /Kids [%s] >>" % (pages, b" ".join(b"%d 0 R" % (4 + i) for i in range(pages))),
            b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(body), body)]
    objs += [b"<< /Type /Page /Parent 2 0 R /Contents 3 0 R >>"] * pages
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (i, o) for i, o in enumerate(objs, 1)) + b"\ntrailer << /Root 1 0 R >>"


def test_pdf_files(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(small_pdf(2))
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    (tmp_path / "locked.pdf").write_bytes(small_pdf() + b"/Encrypt 9 0 R")
    (tmp_path / "long.pdf").write_bytes(small_pdf(4))
    (tmp_path / "note.txt").write_text("x")
    files, rejected = pdf.read_pdfs(spark, str(tmp_path))
    assert {(r["source_file"], r["reason"]) for r in rejected.collect()} == {("note.txt", "not_a_pdf")}
    scan = pdf.scan_pdfs(files, max_pages=3).cache()
    assert {(r["source_file"], r["text"]) for r in scan.where("kind = 'error'").collect()} == {
        ("bad.pdf", "invalid_pdf"), ("locked.pdf", "password_protected"), ("long.pdf", "too_many_pages"),
    }
    words = pdf.native_words(scan).where("page_number = 2").orderBy("word_id").collect()
    assert [w["text"] for w in words] == ["Red.", "broj", "Mo(1)"] and words[0]["x0"] == 80.0 and words[0]["confidence"] == 1.0
    lines = pdf.vector_lines(scan).where("page_number = 1")
    assert (lines.count(), lines.where("is_horizontal").count()) == (5, 3)


def test_stream_takes_up_files_once(spark, tmp_path):
    src, check, seen = tmp_path / "in", str(tmp_path / "check"), []
    src.mkdir()
    (src / "a.pdf").write_bytes(small_pdf())
    write = lambda df, n: seen.append(df.where("kind = 'word'").count())
    ingest.take_up(ingest.pdf_stream(spark, str(src)), write, check).awaitTermination(60)
    (src / "b.pdf").write_bytes(small_pdf(2))
    ingest.take_up(ingest.pdf_stream(spark, str(src)), write, check).awaitTermination(60)
    assert [n for n in seen if n] == [3, 6]


def rules(h=180, w=360):
    image = np.full((h, w), 255, np.uint8)
    for y in (20, 80, 140):
        image[y : y + 2, 20:320] = 0
    for x in (20, 60, 120, 180, 220, 270, 318):
        image[20:142, x : x + 2] = 0
    return image


def test_rules_and_erasing():
    image = rules()
    flat, tall, fm, tm = imaging.ruled_lines(image)
    assert len(flat) == 3 and len(tall) == 7
    image[100:110, 70:76] = 0
    clean = imaging.erase_lines(image, fm, tm)
    assert clean[105, 72] < 60 and clean[81, 100] > 200


def test_skew_ink_and_quality():
    image = np.full((220, 420), 255, np.uint8)
    for y0 in (40, 100, 160):
        for x in range(20, 400):
            image[y0 + round((x - 20) * 13 / 380) : y0 + 2 + round((x - 20) * 13 / 380), x] = 0
    angle = imaging.skew_angle(image)
    assert 1 < angle < 3
    assert abs(imaging.skew_angle(imaging.deskew(image))) < 0.6
    blank = np.full((50, 50), 255, np.uint8)
    assert not imaging.has_ink(blank, 5, 5, 40, 40)
    blank[15:30, 18:22] = 0
    assert imaging.has_ink(blank, 5, 5, 40, 40)
    assert imaging.RenderMetrics.of(np.zeros((40, 40), np.uint8)).reasons() == ["NEAR_BLACK", "LOW_VARIANCE", "NO_EDGES"]
    assert imaging.RenderMetrics.of(rules()).reasons(True) == []
    with pytest.raises(ValueError):
        imaging.render_with_fallbacks(lambda: np.zeros((40, 40), np.uint8), [], True)
    shown, _, name = imaging.render_with_fallbacks(lambda: np.full((40, 40), 255, np.uint8), [("broken", lambda: 1 / 0 if False else None), ("embedded", rules)], True)
    assert name == "embedded" and shown.shape == (180, 360)


def test_other_kernels():
    image = rules()
    assert set(np.unique(imaging.preprocess(image, "clean_scan"))) <= {0, 255}
    for profile in imaging.PROFILES:
        assert imaging.preprocess(image, profile).shape == image.shape
    assert imaging.orient(image, "Rotate: 90").shape == (360, 180) and imaging.orient(image, None) is image
    assert imaging.dominant_image([(10, 1), (60, 2)], 100) == 2 and imaging.dominant_image([(10, 1)], 100) is None
    assert imaging.place_image(image, 100, 100, (0, 0, 100, 50), 72).shape == (100, 100)
    rgb = np.dstack([image] * 3)
    assert (imaging.to_gray(rgb) == image).all() and (imaging.invert(image) == 255 - image).all()


def test_ocr_stub(spark):
    rasters = spark.createDataFrame([("a", 1, 20, 40, bytearray(np.pad(np.zeros((8, 12), np.uint8), ((6, 6), (14, 14)), constant_values=255).tobytes()))], raster.RASTER_SCHEMA)
    words = ocr.ocr_words(rasters).collect()
    assert [(w["text"], w["x0"], w["confidence"], w["source"]) for w in words] == [("xx", 14.0, 1.0, "ocr")]
    assert ocr.missing_languages({"srp"}, ("srp", "eng")) == ["eng"] and ocr.locate_command("/no/such/file", "NO_SUCH_VARIABLE", "no-such-command") is None


@pytest.mark.parametrize("strict", [False, True])
def test_routes(spark, strict):
    kinds = spark.createDataFrame([(k, g) for k in ("digital", "mixed", "scanned") for g in (True, False)], "page_type string, grid boolean")
    from pyspark.sql import functions as F

    for mode in routing.OCR_MODES:
        for r in routing.route(kinds, mode, F.col("grid"), strict).collect():
            scanned, always = r["page_type"] == "scanned", mode == "always"
            assert r["use_native"] == (not always and not scanned)
            assert r["use_ocr"] == (always or (scanned and not (strict and mode == "never")))
            assert r["merge_ocr"] == (r["page_type"] == "mixed" and mode == "automatic")
            assert r["extraction_source"] == ("ocr" if always or scanned else "hybrid" if r["page_type"] == "mixed" and mode != "never" else "native")
    with pytest.raises(ValueError):
        routing.Options(ocr_mode="sometimes")


def test_whole_run(spark, small, tmp_path):
    from gridloom.session import table
    from gridloom.sources.layout import ruled_lines

    words = table(spark, small, "words")
    run = routing.convert(words, ruled_lines(words), routing.Options())
    assert run.counters().agg({"pages_processed": "sum"}).first()[0] == words.select("source_file", "page_number").distinct().count()
    target = run.export(tmp_path / "out.xlsx")
    assert any(name.startswith("Stranica") for name in read(target))
