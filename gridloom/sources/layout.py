"""Pages, words and ruled lines as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = ("source_file", "page_number")


def page_extents(words: DataFrame) -> DataFrame:
    """The box that all words of a page share."""
    return words.groupBy(*PAGE).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def ruled_lines(words: DataFrame, rows: int = 12, columns: int = 6) -> DataFrame:
    """A ruled table laid over the words of every page, as a scanner would see it.

    The word table has no drawings, so the rules follow from the extents of the words:
    every vertical is cut in two fragments with a gap, and edges waver by a unit.
    """
    page = page_extents(words).where("x1 > x0 AND y1 > y0")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    top, bottom = F.col("y0") - 4, F.col("y1") + 4
    at_x = lambda i: F.col("x0") - 3 + i * ((w + 6) / columns)
    at_y = lambda j: F.col("y0") - 4 + j * ((h + 8) / rows)
    wave = lambda k: (k + F.col("page_number")) % 2
    mid = F.col("y0") + h / 2
    line = lambda k, x0, y0, x1, y1: F.struct(
        k.cast("bigint").alias("line_id"), x0.alias("start_x"), y0.alias("start_y"), x1.alias("end_x"), y1.alias("end_y"), F.lit(1.0).alias("thickness")
    )
    verticals = F.transform(
        F.sequence(F.lit(0), F.lit(2 * columns + 1)),
        lambda k: line(
            k,
            at_x(F.floor(k / 2)) + wave(F.floor(k / 2)),
            F.when(k % 2 == 0, top).otherwise(mid + 3),
            at_x(F.floor(k / 2)) + wave(F.floor(k / 2)),
            F.when(k % 2 == 0, mid - 3).otherwise(bottom),
        ),
    )
    horizontals = F.transform(
        F.sequence(F.lit(0), F.lit(rows)),
        lambda j: line(j + 1000, F.col("x0") - 3, at_y(j) + wave(j) * 0.5, F.col("x1") + 4, at_y(j) + wave(j) * 0.5),
    )
    return page.select(*PAGE, F.inline(F.concat(verticals, horizontals))).withColumn("is_horizontal", is_horizontal())


def is_horizontal():
    """A line is horizontal if it does not rise more than it runs; a point is."""
    return F.abs(F.col("end_y") - F.col("start_y")) <= F.abs(F.col("end_x") - F.col("start_x"))


def oriented(lines: DataFrame) -> DataFrame:
    """Endpoints in ascending order, so that span tests hold for lines drawn backwards."""
    swap = F.when(F.col("is_horizontal"), F.col("start_x") > F.col("end_x")).otherwise(F.col("start_y") > F.col("end_y"))
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    ends = {a: pick(a, b) for a, b in (("start_x", "end_x"), ("start_y", "end_y"), ("end_x", "start_x"), ("end_y", "start_y"))}
    return lines.withColumns(ends)


def page_analysis(words: DataFrame, images: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Statistics and kind of every page.

    ``images`` optionally has ``image_area`` by page, ``sizes`` the ``page_width`` and
    ``page_height`` of every page; without it only pages with words are known. Digital pages have at least 20
    characters in 4 words of which 55 % are usable; pages covered by images to 45 % or
    more are scans; pages that are both are mixed.
    """
    area = lambda: (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    stats = words.groupBy(*PAGE).agg(
        F.sum(F.length(F.regexp_replace("text", r"(?U)\s", ""))).cast("bigint").alias("character_count"),
        F.count(F.lit(1)).alias("word_count"),
        F.count_if(F.coalesce(F.col("text"), F.lit("")).rlike(r"[\p{L}\p{N}]")).alias("usable"),
        F.sum(area()).alias("word_area"),
        ((F.max("x1") - F.min("x0")) * (F.max("y1") - F.min("y0"))).alias("page_area"),
        F.count_if(F.col("source") == "ocr").alias("n_ocr"),
    )
    if sizes is not None:
        stats = sizes.join(stats, list(PAGE), "left").withColumns(
            {"page_area": F.col("page_width") * F.col("page_height"), "word_count": F.coalesce("word_count", F.lit(0)), "usable": F.coalesce("usable", F.lit(0))}
        )
    if images is not None:
        stats = stats.join(images, list(PAGE), "left").withColumn("image_area", F.coalesce("image_area", F.lit(0.0)))
    else:  # a page read by OCR is an image all over
        stats = stats.withColumn("image_area", F.when(F.col("n_ocr") > 0, F.col("page_area")).otherwise(0.0))
    share = lambda c: F.when(F.col("page_area") > 0, F.least(F.lit(1.0), F.col(c) / F.col("page_area"))).otherwise(0.0)
    ratio = F.when(F.col("word_count") > 0, F.col("usable") / F.col("word_count")).otherwise(0.0)
    digital = (F.col("character_count") >= 20) & (F.col("word_count") >= 4) & (ratio >= 0.55)
    out = stats.select(
        *PAGE, F.coalesce("character_count", F.lit(0)).alias("character_count"), "word_count",
        F.coalesce(share("word_area"), F.lit(0.0)).alias("text_coverage") if sizes is not None else share("word_area").alias("text_coverage"), share("image_area").alias("image_coverage"), ratio.alias("usable_word_ratio"),
        F.coalesce(digital, F.lit(False)).alias("_digital"),
    )
    scan = F.col("image_coverage") >= 0.45
    kind = F.when(F.col("_digital") & scan, "mixed").when(F.col("_digital"), "digital").otherwise("scanned")
    return out.withColumn("page_type", kind).drop("_digital")
