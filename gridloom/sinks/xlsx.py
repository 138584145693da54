"""Workbooks written with the standard library, whole or not at all."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.operators.forms import ITEM_FIELDS

#: Sheet titles and columns of the structured workbook.
EQUIPMENT_COLUMNS = {
    "source_file": "Izvorna datoteka", "page_number": "Stranica", "person_name": "Osoba", "person_identifier": "JMBG",
    "organization_unit": "Organizaciona jedinica", "item_number": "Redni broj", "equipment_type": "Vrsta opreme", "model": "Model",
    "quantity": "Količina", "serial_number": "Serijski broj", "inventory_number": "Inventarski broj", "handover_date": "Datum primopredaje",
    "handed_over_by": "Opremu predao", "received_by": "Opremu primio", "confidence": "Pouzdanost",
}
REVIEW_COLUMNS = {
    "severity": "Ozbiljnost", "code": "Šifra upozorenja", "page_number": "Stranica", "row_no": "Red", "field_name": "Polje",
    "field_value": "Izdvojena vrednost", "confidence": "Pouzdanost", "source": "Izvor", "message": "Upozorenje",
}
ITEM_CAPTIONS = ("Red. broj", "Vrsta računarske opreme", "Model", "Kol", "Serijski broj", "Inventarski broj")
EQUIPMENT_SHEET, DOCUMENT_SHEET, REVIEW_SHEET, EMPTY_SHEET = "Oprema", "Dokument", "Pregled", "Nema tabela"
EMPTY_NOTICE = "Nije pronađena nijedna tabela."
#: A title may be this long.
TITLE_LIMIT = 31

Value = str | int | float | date | datetime | None


@dataclass
class Sheet:
    title: str
    rows: Iterable[Sequence[Value]]
    header: Sequence[str] = ()
    text_columns: frozenset[int] = field(default_factory=frozenset)


def available_path(wanted: Path) -> Path:
    """The path itself if free, else the first free one with a number before the suffix."""
    if not wanted.exists():
        return wanted
    k = 1
    while (other := wanted.with_name(f"{wanted.stem} ({k}){wanted.suffix}")).exists():
        k += 1
    return other


def unique_title(taken: Iterable[str], wanted: str) -> str:
    """At most 31 characters and not taken; a number is added within the limit."""
    taken = {t.casefold() for t in taken}
    base = re.sub(r"[\[\]:*?/\\]", "_", wanted)[:TITLE_LIMIT] or "Sheet"
    title, k = base, 2
    while title.casefold() in taken:
        mark = f" ({k})"
        title, k = base[: TITLE_LIMIT - len(mark)] + mark, k + 1
    return title


def column_name(index: int) -> str:
    name = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        name = chr(65 + rest) + name
    return name


_EPOCH = datetime(1899, 12, 30)
_PLAIN, _HEADER, _TEXT, _DATE = range(4)
_STYLES = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts count="1"><numFmt numFmtId="164" formatCode="dd.mm.yyyy"/></numFmts><fonts count="2"><font><sz val="11"/></font><font><b/><color rgb="FFFFFFFF"/><sz val="11"/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF2F5597"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf><alignment vertical="top" wrapText="1"/></xf><xf fontId="1" fillId="2" applyFont="1" applyFill="1"><alignment vertical="top" wrapText="1"/></xf><xf numFmtId="49" applyNumberFormat="1"><alignment vertical="top" wrapText="1"/></xf><xf numFmtId="164" applyNumberFormat="1"><alignment vertical="top" wrapText="1"/></xf></cellXfs></styleSheet>"""


def _cell(ref: str, value: Value, style: int) -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, bool):
        value = str(value)
    if isinstance(value, (int, float)):
        return f'<c r="{ref}" s="{style}"><v>{value!r}</v></c>'
    if isinstance(value, date):
        moment = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
        return f'<c r="{ref}" s="{_DATE}"><v>{(moment - _EPOCH).total_seconds() / 86400!r}</v></c>'
    clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", value)
    return f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def _sheet_xml(sheet: Sheet, out) -> None:
    """Rows go to the file as they come; widths need them first, so cells are buffered by sheet on disk."""
    widths: dict[int, int] = {}
    n_rows = n_cols = 0
    with tempfile.SpooledTemporaryFile(max_size=1 << 24, mode="w+", encoding="utf-8") as body:
        every = ([*sheet.header] if sheet.header else None, *())
        for head, row in _with_header(every[0], sheet.rows):
            n_rows += 1
            n_cols = max(n_cols, len(row))
            body.write(f'<row r="{n_rows}">')
            for k, value in enumerate(row):
                widths[k] = max(widths.get(k, 0), len("" if value is None else str(value)))
                style = _HEADER if head else _TEXT if k in sheet.text_columns else _PLAIN
                body.write(_cell(f"{column_name(k)}{n_rows}", value, style))
            body.write("</row>")
        body.seek(0)
        out.write('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">')
        out.write('<sheetViews><sheetView showGridLines="1" workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>')
        if n_cols:
            out.write("<cols>")
            for k in range(n_cols):
                out.write(f'<col min="{k + 1}" max="{k + 1}" width="{column_width(widths.get(k, 0))}" customWidth="1"/>')
            out.write("</cols>")
        out.write("<sheetData>")
        while part := body.read(1 << 20):
            out.write(part)
        out.write("</sheetData>")
        if n_cols:
            out.write(f'<autoFilter ref="A1:{column_name(n_cols - 1)}{max(1, n_rows)}"/>')
        out.write("</worksheet>")


def _with_header(header: Sequence[str] | None, rows: Iterable[Sequence[Value]]) -> Iterator[tuple[bool, Sequence[Value]]]:
    if header:
        yield True, header
    first = not header
    for row in rows:
        yield first, row
        first = False


def column_width(longest: int) -> int:
    return min(60, max(10, longest + 2))


def write_workbook(sheets: Iterable[Sheet], wanted: Path | str, overwrite: bool = False) -> Path:
    """Writes beside the target, reads it back, and only then puts it in place."""
    target = Path(wanted) if overwrite else available_path(Path(wanted))
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(suffix=".xlsx", dir=target.parent)
    os.close(handle)
    try:
        titles: list[str] = []
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
            for sheet in sheets:
                titles.append(unique_title(titles, sheet.title))
                with z.open(f"xl/worksheets/sheet{len(titles)}.xml", "w") as raw:
                    import io

                    with io.TextIOWrapper(raw, encoding="utf-8", write_through=True) as out:
                        _sheet_xml(sheet, out)
            if not titles:
                titles.append(EMPTY_SHEET)
                with z.open("xl/worksheets/sheet1.xml", "w") as raw:
                    import io

                    with io.TextIOWrapper(raw, encoding="utf-8") as out:
                        _sheet_xml(Sheet(EMPTY_SHEET, [(EMPTY_NOTICE,)]), out)
            _package(z, titles)
        with zipfile.ZipFile(name) as z:
            if z.testzip() is not None or len(z.namelist()) < len(titles) + 4:
                raise OSError("the workbook could not be read back")
        os.replace(name, target)
    finally:
        if os.path.exists(name):
            os.unlink(name)
    return target


def _package(z: zipfile.ZipFile, titles: list[str]) -> None:
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    n = len(titles)
    types = "".join(
        f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, n + 1)
    )
    z.writestr(
        "[Content_Types].xml",
        head + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + types + "</Types>",
    )
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006/relationships"
    z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pack}"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    listed = "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, t in enumerate(titles, 1))
    z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
    links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1))
    z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pack}">{links}<Relationship Id="rId{n + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
    z.writestr("xl/styles.xml", _STYLES)


def equipment_sheet(forms: DataFrame, items: DataFrame) -> DataFrame:
    """Items with the fields of their form, in the columns of the equipment sheet; text is formula safe."""
    named = forms.select("source_file", "page_number", "person_name", "person_identifier", "organization_unit", "handover_date", "handed_over_by", "received_by")
    both = items.join(named, ["source_file", "page_number"])
    return both.select(*((T.formula_safe(F.col(c)) if t == "string" else F.col(c)).alias(c) for c in EQUIPMENT_COLUMNS for t in [dict(both.dtypes)[c]]))


def structured_sheets(forms: DataFrame, items: DataFrame, warnings: DataFrame) -> list[Sheet]:
    """The three sheets of the structured workbook; rows are streamed, not gathered."""
    equipment = equipment_sheet(forms, items).orderBy("source_file", "page_number", "item_number")
    sheets = [Sheet(EQUIPMENT_SHEET, ([r[c] for c in EQUIPMENT_COLUMNS] for r in equipment.toLocalIterator()), list(EQUIPMENT_COLUMNS.values()), frozenset({3, 9, 10}))]
    sheets.append(Sheet(DOCUMENT_SHEET, _document_rows(forms, items)))
    if warnings.limit(1).count():
        ordered = warnings.orderBy("source_file", "page_number", "row_no")
        sheets.append(Sheet(REVIEW_SHEET, ([r[c] for c in REVIEW_COLUMNS] for r in ordered.toLocalIterator()), list(REVIEW_COLUMNS.values())))
    return sheets


def _document_rows(forms: DataFrame, items: DataFrame) -> Iterator[Sequence[Value]]:
    listed = items.groupBy("source_file", "page_number").agg(F.array_sort(F.collect_list(F.struct(*ITEM_FIELDS))).alias("items"))
    for d in forms.join(listed, ["source_file", "page_number"], "left").orderBy("source_file", "page_number").toLocalIterator():
        yield ("REVERS",)
        for caption, name in (("Osoba", "person_name"), ("JMBG", "person_identifier"), ("Organizaciona jedinica", "organization_unit"),
                              ("Datum primopredaje", "handover_date"), ("Opremu predao", "handed_over_by"), ("Opremu primio", "received_by")):
            yield (caption, d[name])
        yield ()
        yield ITEM_CAPTIONS
        for item in d["items"] or ():
            yield [item[f] for f in ITEM_FIELDS]


def table_sheets(cells: DataFrame) -> Iterator[Sheet]:
    """A sheet for each table of typed, formula-safe cells, in the order of file, page and table."""
    typed = cells.select("source_file", "page_number", "table_index", "row", "col", T.export_value(F.col("text")).alias("v"))
    rows = typed.groupBy("source_file", "page_number", "table_index", "row").agg(F.array_sort(F.collect_list(F.struct("col", "v"))).alias("cells"))
    ordered = rows.orderBy("source_file", "page_number", "table_index", "row")
    current, held = None, []
    for r in ordered.toLocalIterator():
        key = (r["source_file"], r["page_number"], r["table_index"])
        if key != current and held:
            yield Sheet(f"Stranica {current[1]} Tabela {current[2]}", held)
            held = []
        current = key
        held.append([_native(c["v"]) for c in r["cells"]])
    if held:
        yield Sheet(f"Stranica {current[1]} Tabela {current[2]}", held)


def _native(v) -> Value:
    return {"int": v["i"], "float": v["d"], "date": v["t"]}.get(v["kind"], v["s"]) if v else None
