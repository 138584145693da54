"""Which path each page takes, and the run as a whole."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.operators import cluster, forms, grids, merge
from gridloom.session import cut_lineage, release_past
from gridloom.sinks import xlsx
from gridloom.sources import ocr, pdf, raster
from gridloom.sources.layout import PAGE, page_analysis

KEYS = list(PAGE)
OCR_MODES = ("automatic", "always", "never")
OUTPUT_MODES = ("structured", "preserve_tables", "both")


@dataclass(frozen=True)
class Options:
    """Choices of a run. ``strict_never`` honours "never" on scanned pages too."""

    ocr_mode: str = "automatic"
    output_mode: str = "both"
    pages: tuple[int, ...] = ()
    dpi: int = 300
    max_dpi: int = 400
    max_size: int = 250 * 1024 * 1024
    max_pages: int = 500
    ocr_threshold: float = 0.35
    keep_empty_rows: bool = False
    strict_never: bool = True

    def __post_init__(self) -> None:
        if self.ocr_mode not in OCR_MODES or self.output_mode not in OUTPUT_MODES:
            raise ValueError("unknown mode")
        if self.dpi > self.max_dpi or not 0 <= self.ocr_threshold <= 1:
            raise ValueError("dpi or threshold out of range")

    @classmethod
    def load(cls, path: str | Path) -> Options:
        """Options from a JSON file; defaults where it does not exist or is silent."""
        given = json.loads(Path(path).read_text("utf-8")) if Path(path).exists() else {}
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if k == "pages" else v for k, v in given.items() if k in known})

    def save(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(asdict(self), indent=2, ensure_ascii=False), "utf-8")


def route(pages: DataFrame, ocr_mode: Column | str, has_form_grid: Column, strict_never: bool = False) -> DataFrame:
    """Decisions for every page from its kind, the OCR mode and whether a form grid was drawn.

    Adds ``use_native, needs_raster, use_ocr, merge_ocr, extraction_source``.
    """
    mode = F.lit(ocr_mode) if isinstance(ocr_mode, str) else ocr_mode
    kind = F.col("page_type")
    always, never = mode == "always", mode == "never"
    scanned = kind == "scanned"
    reads_scan = scanned & ~never if strict_never else scanned
    return pages.withColumns(
        {
            "use_native": ~always & ~scanned,
            "needs_raster": (always | kind.isin("scanned", "mixed") | ~has_form_grid) & (~never if strict_never else F.lit(True)),
            "use_ocr": always | reads_scan,
            "merge_ocr": (kind == "mixed") & ~never & ~always,
            "extraction_source": F.when(always | scanned, "ocr").when((kind == "mixed") & ~never, "hybrid").otherwise("native"),
        }
    )


def select_pages(pages: DataFrame, wanted: tuple[int, ...]) -> DataFrame:
    """The wanted pages of every file in their order, repetitions kept; all pages if none is named.

    Adds ``position`` from 0.
    """
    if not wanted:
        return pages.withColumn("position", (F.col("page_number") - 1).cast("bigint"))
    asked = pages.sparkSession.createDataFrame([(i, p) for i, p in enumerate(wanted)], "position bigint, page_number bigint")
    return pages.join(F.broadcast(asked), "page_number")  # as long as the list of an option


def usable_words(words: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Words with text; those of OCR also with enough confidence."""
    filled = F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\S")
    sure = (F.col("source") != "ocr") | (F.coalesce(F.col("confidence"), F.lit(0.0)) >= threshold)
    return words.where(filled & sure)


def first_available(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``first``, and those of ``second`` for keys that ``first`` lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def word_tables(words: DataFrame) -> DataFrame:
    """A table of each page without rules: a row for each row of words, a cell for each word."""
    rows = cluster.text_lines(words, KEYS, 4.0, along="top")
    return rows.select(
        *KEYS, F.lit(1).cast("bigint").alias("table_index"), F.col("line_no").cast("int").alias("row"), F.col("place").cast("int").alias("col"),
        T.normalize_text(F.coalesce("text", F.lit(""))).alias("text"), "confidence",
    )


@dataclass
class Run:
    """What a run found; all DataFrames are lazy."""

    pages: DataFrame
    words: DataFrame
    grids: DataFrame
    cells: DataFrame
    tables: DataFrame
    records: DataFrame
    items: DataFrame
    warnings: DataFrame
    options: Options = field(default_factory=Options)

    def counters(self) -> DataFrame:
        """Pages by extraction source, tables and filled items of each file."""
        pages = self.pages.groupBy("source_file").agg(
            F.count(F.lit(1)).alias("pages_processed"),
            *(F.count_if(F.col("extraction_source") == s).alias(f"{s}_pages") for s in ("native", "hybrid", "ocr")),
        )
        tables = self.tables.groupBy("source_file").agg(F.count_distinct("page_number", "table_index").alias("tables"))
        items = self.items.groupBy("source_file").agg(F.count(F.lit(1)).alias("records"))
        out = pages.join(tables, "source_file", "left").join(items, "source_file", "left")
        return out.fillna(0, ["tables", "records"])

    def forms(self) -> DataFrame:
        """Every page with its route and, where it is a form, its fields and items."""
        return self.pages.select(*KEYS, "page_type", "extraction_source").join(self.records, KEYS, "left")

    def export(self, target: str | Path) -> Path:
        sheets: list[xlsx.Sheet] = []
        if self.options.output_mode in ("structured", "both") and self.records.limit(1).count():
            sheets += xlsx.structured_sheets(self.records, self.items, self.warnings)
        if self.options.output_mode in ("preserve_tables", "both"):
            sheets += list(xlsx.table_sheets(self.tables))
        return xlsx.write_workbook(sheets, target)


def routes(pages: DataFrame, best: DataFrame, options: Options) -> DataFrame:
    """The wanted pages with their routes; ``best`` has the form grid of each page."""
    drawn = select_pages(pages, options.pages).join(best.select(*KEYS, F.col("accepted").alias("_form")), KEYS, "left")
    return route(drawn, options.ocr_mode, F.coalesce(F.col("_form"), F.lit(False)), options.strict_never).drop("_form")


def convert(
    words: DataFrame, lines: DataFrame, options: Options = Options(), sizes: DataFrame | None = None,
    pages: DataFrame | None = None, notes: DataFrame | None = None,
) -> Run:
    """Words and ruled lines of any number of files to tables and form records.

    What several results share (merged words, grids, cells) is written to the shared
    checkpoint folder once; the results themselves are lazy.
    ``sizes`` has the pages with their sizes and ``pages`` their routes where they are
    known, ``notes`` warnings that came before.
    """
    if pages is None and options.pages:
        asked = F.broadcast(words.sparkSession.createDataFrame([(p,) for p in set(options.pages)], "page_number bigint"))  # as long as the list of an option
        words, lines = words.join(asked, "page_number", "left_semi"), lines.join(asked, "page_number", "left_semi")
    good = usable_words(words, options.ocr_threshold)
    merged, doubts = merge.merge_words(good)
    read = cut_lineage(merged.drop("position"))
    found = cut_lineage(grids.detect_grids(cluster.merge_collinear(lines)))
    size = sizes if sizes is not None else read.groupBy(*KEYS).agg(F.max("x1").alias("page_width"), F.max("y1").alias("page_height"))
    best = grids.form_grid(found, size)
    routed = pages if pages is not None else routes(page_analysis(words), best, options)
    release_past(words.sparkSession)
    cells = cut_lineage(grids.cell_table(read, found))
    matched = forms.match_templates(forms.page_text(read)).where("accepted").select(*KEYS, F.col("confidence").alias("template_confidence"))
    form = cut_lineage(best.where("accepted").join(matched, KEYS))
    release_past(words.sparkSession)
    form_cells = cells.join(form.select(*KEYS, "grid_id"), [*KEYS, "grid_id"], "left_semi")
    items = forms.equipment_rows(form_cells, options.keep_empty_rows)
    records = forms.form_records(read, form, form_cells)
    scores = grids.grid_scores(cells, found, size)
    ruled = grids.clean_tables(grids.ruled_tables(cells, scores), [*KEYS, "table_index"])
    plain = read.join(form.select(*KEYS), KEYS, "left_anti")
    tables = first_available(ruled, grids.clean_tables(word_tables(plain), [*KEYS, "table_index"]), KEYS)
    _, dates = forms.footer_fields(read, form)
    blank = lambda t: F.lit(None).cast(t)
    warnings = doubts.select(
        *KEYS, blank("int").alias("row_no"), blank("string").alias("field_name"), "field_value", "confidence", "source", "code", "severity", "message"
    ).unionByName(
        dates.select(
            *KEYS, blank("int").alias("row_no"), "field_name", "field_value", blank("double").alias("confidence"), blank("string").alias("source"),
            F.lit("INVALID_DATE").alias("code"), F.lit("warning").alias("severity"), "message",
        )
    )
    warnings = warnings.unionByName(notes, allowMissingColumns=True) if notes is not None else warnings
    return Run(routed, read, found, cells, tables, records, items, warnings, options)


def convert_pdfs(
    spark: SparkSession, folder: str, options: Options = Options(), backend: str = "own", renderer: str = "own",
    engine: str | None = None, languages: tuple[str, ...] = ("any",),
) -> tuple[Run, DataFrame]:
    """The run over all PDF files of a folder, and the files it had to refuse with the reason.

    Files are parsed once; words, rules and page facts come from the same rows, which
    are written to the shared checkpoint folder, and so are the pictures of the pages
    that need one. ``engine`` names the registered OCR engine. A page that needs OCR and
    cannot have it (no engine, or no picture) stays in the pages and has a warning; its
    native words, if any, are then used.
    """
    files, refused = pdf.read_pdfs(spark, folder, options.max_size)
    scan = cut_lineage(pdf.scan_pdfs(files, options.max_pages, backend))
    failed = scan.where("kind = 'error'").select("source_file", F.col("text").alias("reason"))
    native, drawn, sizes = pdf.native_words(scan), pdf.vector_lines(scan), pdf.page_sizes(scan)
    best = grids.form_grid(grids.detect_grids(cluster.merge_collinear(drawn)), sizes)
    routed = cut_lineage(routes(page_analysis(native, pdf.image_areas(scan), sizes), best, options))
    wanted = routed.select(*KEYS, "use_native", "use_ocr", "merge_ocr", "needs_raster").distinct()
    # Our own pictures show images and rules only, so a native page without images has nothing new on them.
    shown = wanted.where("use_ocr OR merge_ocr") if renderer == "own" else wanted
    pictures = shown.unionByName(wanted.join(pdf.image_areas(scan), KEYS, "left_semi")).distinct() if renderer == "own" else shown
    rasters = cut_lineage(pdf.render_pages(files, pictures.where("needs_raster"), options.dpi, renderer))
    good = rasters.where("reason IS NULL").drop("reason")
    rules = raster.in_points(raster.raster_lines(good), good, sizes, ("start_x", "end_x"), ("start_y", "end_y"))
    # A form grid drawn in the page itself is enough, unless OCR reads the picture.
    rules = rules.join(best.where("accepted").select(*KEYS).join(wanted.where("use_ocr"), KEYS, "left_anti"), KEYS, "left_anti")
    ocr_pages = wanted.where("use_ocr OR merge_ocr").select(*KEYS, "use_ocr")
    note = lambda df, code, message: df.select(*KEYS, F.lit(code).alias("code"), F.lit("warning").alias("severity"), message.alias("message"))
    notes = note(ocr_pages.join(rasters.where("reason IS NOT NULL"), KEYS), "RENDER_FAILED", F.col("reason"))
    able = good.select(*KEYS)
    if engine is None:
        notes = notes.unionByName(note(ocr_pages, "OCR_UNAVAILABLE", F.lit("The page needs OCR and no engine is named")))
        able = able.limit(0)
    words = native.join(wanted.where("use_native").select(*KEYS).unionByName(wanted.where("use_ocr").select(*KEYS).join(able, KEYS, "left_anti")), KEYS, "left_semi")
    if engine is not None:
        alone = good.join(ocr_pages.where("use_ocr"), KEYS, "left_semi")
        beside = good.join(ocr_pages.where("NOT use_ocr"), KEYS, "left_semi")
        seen = ocr.ocr_words(raster.without_rules(alone), engine, languages, options.ocr_threshold, "clean_scan").unionByName(
            ocr.ocr_words(beside, engine, languages, options.ocr_threshold, "auto")
        )
        seen = raster.in_points(seen, good, sizes, ("x0", "x1"), ("y0", "y1"))
        # Numbers of native words run through the file; those of OCR follow behind.
        words = words.unionByName(seen.withColumns({"word_id": F.col("word_id") + 1_000_000_000, "coord_space": F.lit("points")}))
    by_raster = ocr_pages.where("use_ocr").join(able, KEYS, "left_semi")
    lines = drawn.join(wanted.select(*KEYS), KEYS, "left_semi").join(by_raster, KEYS, "left_anti").unionByName(rules.withColumn("line_id", F.col("line_id") + 1_000_000_000))
    words, lines = cut_lineage(words), cut_lineage(lines)
    return convert(words, lines, options, sizes, routed, notes), refused.unionByName(failed)


def progress(spark: SparkSession, tag: str) -> tuple[int, int]:
    """Finished and known tasks of the running jobs of a tag or job group."""
    tracker = spark.sparkContext.statusTracker()
    done = known = 0
    for job in tracker.getJobIdsForGroup(tag):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            if facts := tracker.getStageInfo(stage):
                done, known = done + facts.numCompletedTasks, known + facts.numTasks
    return done, known
