from __future__ import annotations

import json
import zlib

import numpy as np

from gridloom import doctor
from gridloom.plans import reference, routing
from tests.test_sinks_sources import read


def table_pdf(ruled: bool = True) -> bytes:
    """A table of four rows and three columns on one page."""
    xs, ys = (72, 220, 370, 520), (700, 660, 620, 580, 540)
    draw = [f"{xs[0]} {y} m {xs[-1]} {y} l S" for y in ys] + [f"{x} {ys[0]} m {x} {ys[-1]} l S" for x in xs]
    cells = [("Ime", "Telefon", "Iznos"), ("Ana", "0641234567", "12"), ("Ivo", "=cmd()", "1,5"), ("Mia", "05.01.2026", "5.1.2026")]
    text = [f"BT /F1 10 Tf 1 0 0 1 {xs[c] + 10} {ys[r] - 25} Tm ({v.replace('(', chr(92) + '(').replace(')', chr(92) + ')')}) Tj ET" for r, row in enumerate(cells) for c, v in enumerate(row)]
    body = zlib.compress("\n".join(draw * ruled + text).encode("cp1252"))
    objs = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>",
            b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents 4 0 R >>", b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(body), body)]
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (i, o) for i, o in enumerate(objs, 1)) + b"\ntrailer << /Root 1 0 R >>"


def test_pdf_to_workbook(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "table.pdf").write_bytes(table_pdf())
    (source / "broken.pdf").write_bytes(b"no")
    run, refused = routing.convert_pdfs(spark, str(source))
    assert [tuple(r) for r in refused.collect()] == [("broken.pdf", "invalid_pdf")]
    sheets = read(run.export(tmp_path / "out.xlsx"))
    assert list(sheets) == ["Stranica 1 Tabela 1"]
    rows = [[a or b for a, b in row] for row in sheets["Stranica 1 Tabela 1"]]
    assert rows == [["Ime", "Telefon", "Iznos"], ["Ana", "0641234567", "12"], ["Ivo", "'=cmd()", "1.5"], ["Mia", "05.01.2026", "46027.0"]]


def test_borderless_page_keeps_its_words(spark, tmp_path):
    (tmp_path / "table.pdf").write_bytes(table_pdf(ruled=False))
    run, _ = routing.convert_pdfs(spark, str(tmp_path))
    assert run.counters().first()["tables"] == 1
    rows = [[a or b for a, b in row] for row in read(run.export(tmp_path / "out.xlsx"))["Stranica 1 Tabela 1"]]
    assert rows == [["Ime", "Telefon", "Iznos"], ["Ana", "0641234567", "12"], ["Ivo", "'=cmd()", "1.5"], ["Mia", "05.01.2026", "46027.0"]]


def scanned_pdf(natives: bool = False) -> bytes:
    """A page that is one picture: a ruled table of four rows and three columns with a blob in each cell."""
    image = np.full((842, 595), 255, np.uint8)
    xs, ys = (72, 220, 370, 520), (140, 180, 220, 260, 300)
    for y in ys:
        image[y : y + 2, xs[0] : xs[-1] + 2] = 0
    for x in xs:
        image[ys[0] : ys[-1] + 2, x : x + 2] = 0
    for y in ys[:-1]:
        for x in xs[:-1]:
            image[y + 14 : y + 26, x + 40 : x + 54] = 0
    text = " BT /F1 10 Tf 1 0 0 1 72 60 Tm (Nekoliko sasvim obicnih reci ispod tabele) Tj ET" if natives else ""
    body, pixels = f"q 595 0 0 842 0 0 cm /Im0 Do Q{text}".encode(), zlib.compress(image.tobytes())
    objs = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>",
            b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents 4 0 R /Resources << /XObject << /Im0 5 0 R >> >> >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body),
            b"<< /Type /XObject /Subtype /Image /Width 595 /Height 842 /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(pixels), pixels)]
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (i, o) for i, o in enumerate(objs, 1)) + b"\ntrailer << /Root 1 0 R >>"


def test_scanned_pages_are_read(spark, tmp_path):
    (tmp_path / "scan.pdf").write_bytes(scanned_pdf())
    (tmp_path / "both.pdf").write_bytes(scanned_pdf(natives=True))
    run, _ = routing.convert_pdfs(spark, str(tmp_path), routing.Options(dpi=72), engine="blobs")
    assert {r["source_file"]: (r["page_type"], r["extraction_source"]) for r in run.pages.collect()} == {"scan.pdf": ("scanned", "ocr"), "both.pdf": ("mixed", "hybrid")}
    table = {(r["row"], r["col"]): r["text"] for r in run.tables.where("source_file = 'scan.pdf'").collect()}
    assert len(table) == 12 and all(set(t) == {"x"} for t in table.values())
    sources = {(r["source_file"], r["source"]) for r in run.words.select("source_file", "source").distinct().collect()}
    assert sources == {("scan.pdf", "ocr"), ("both.pdf", "ocr"), ("both.pdf", "native")}


def test_scanned_pages_are_named_without_engine(spark, tmp_path):
    (tmp_path / "scan.pdf").write_bytes(scanned_pdf())
    (tmp_path / "table.pdf").write_bytes(table_pdf())
    run, _ = routing.convert_pdfs(spark, str(tmp_path), routing.Options(dpi=72))
    assert {r["source_file"]: r["pages_processed"] for r in run.counters().collect()} == {"scan.pdf": 1, "table.pdf": 1}
    assert [(r["source_file"], r["code"]) for r in run.warnings.collect()] == [("scan.pdf", "OCR_UNAVAILABLE")]
    left, _ = routing.convert_pdfs(spark, str(tmp_path), routing.Options(dpi=72, pages=(2,)))
    assert left.pages.count() == left.words.count() == left.tables.count() == 0


def test_form_records_of_every_page(spark, small):
    got = reference.QUERIES["x02_form_records"](spark, small)
    assert {"person_name", "handed_over_by", "received_by", "handover_date", "items"} <= set(got.columns)
    pages = {tuple(r) for r in reference.words(spark, small).select("source_file", "page_number").distinct().collect()}
    assert sorted(pages) == sorted((r["source_file"], r["page_number"]) for r in got.collect())


def test_options_round_trip(tmp_path):
    path = tmp_path / "a" / "options.json"
    assert routing.Options.load(path) == routing.Options()
    chosen = routing.Options(ocr_mode="always", pages=(2, 1, 2), dpi=200)
    chosen.save(path)
    assert routing.Options.load(path) == chosen
    path.write_text(json.dumps({"dpi": 150, "unknown": 1}))
    assert routing.Options.load(path).dpi == 150


def test_doctor_and_log(tmp_path):
    assert doctor.self_test(tmp_path / "r.json") == 0 and json.loads((tmp_path / "r.json").read_text())["ok"]
    log = doctor.log_to(tmp_path / "log" / "g.log")
    log.info("x")
    assert doctor.log_to(tmp_path / "other.log") is log and (tmp_path / "log" / "g.log").read_text().endswith("x\n")


def test_progress_counts_tasks(spark):
    spark.sparkContext.setJobGroup("counted", "")
    spark.range(100, numPartitions=4).selectExpr("sum(id)").collect()
    done, known = routing.progress(spark, "counted")
    assert 0 < done <= known
