"""Grids of ruled lines: detection, cells, word assignment, scores, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geometry import Box, boundary_count, cell_rects
from gridloom.operators import cluster
from gridloom.sources.layout import PAGE, oriented

KEYS = list(PAGE)


def continuous_groups(positions: DataFrame, horizontal: DataFrame, tolerance: float) -> DataFrame:
    """Vertical axes with ``group_no``: neighbours belong together if some horizontal rule bridges them."""
    w = Window.partitionBy(*KEYS).orderBy("position")
    pairs = positions.withColumn("_prev", F.lag("position").over(w))
    spans = horizontal.select(*KEYS, F.col("start_x").alias("_a"), F.col("end_x").alias("_b"))
    bridged = (
        pairs.where("_prev IS NOT NULL")
        .join(spans, KEYS)
        .where((F.col("_a") <= F.col("_prev") + tolerance) & (F.col("_b") >= F.col("position") - tolerance))
        .select(*KEYS, "position")
        .distinct()
        .withColumn("_joined", F.lit(True))
    )
    flagged = pairs.join(bridged, [*KEYS, "position"], "left")
    cut = F.when(F.col("_prev").isNotNull() & F.col("_joined").isNull(), 1).otherwise(0)
    return flagged.withColumn("group_no", F.sum(cut).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_prev", "_joined")


def spanning_rows(groups: DataFrame, rows: DataFrame, horizontal: DataFrame, tolerance: float) -> DataFrame:
    """Horizontal axes at which one rule spans a whole group of vertical ones."""
    extent = groups.groupBy(*KEYS, "group_no").agg(F.min("position").alias("left"), F.max("position").alias("right"), F.count(F.lit(1)).alias("n_cols")).where("n_cols >= 2")
    rules = horizontal.select(*KEYS, F.col("start_y").alias("_y"), F.col("start_x").alias("_a"), F.col("end_x").alias("_b"))
    near = rows.select(*KEYS, F.col("position").alias("row_y")).join(rules, KEYS).where(F.abs(F.col("row_y") - F.col("_y")) <= tolerance)
    return (
        extent.join(near, KEYS)
        .where((F.col("_a") <= F.col("left") + tolerance) & (F.col("_b") >= F.col("right") - tolerance))
        .select(*KEYS, "group_no", "row_y")
        .distinct()
    )


def detect_grids(lines: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Grids of each page, the largest first: ``grid_id, x0, y0, x1, y1, row_boundaries, column_boundaries``."""
    lines = oriented(lines)
    horizontal, vertical = lines.where("is_horizontal"), lines.where("NOT is_horizontal")
    cols = cluster.axis_clusters(vertical, KEYS, "start_x", tolerance).select(*KEYS, "position")
    rows = cluster.axis_clusters(horizontal, KEYS, "start_y", tolerance).select(*KEYS, "position")
    groups = continuous_groups(cols, horizontal, tolerance)
    kept = spanning_rows(groups, rows, horizontal, tolerance)
    xs = groups.groupBy(*KEYS, "group_no").agg(F.array_sort(F.collect_list("position")).alias("column_boundaries"))
    ys = kept.groupBy(*KEYS, "group_no").agg(F.array_sort(F.collect_list("row_y")).alias("row_boundaries"))
    grids = xs.join(ys, [*KEYS, "group_no"]).where("size(column_boundaries) >= 2 AND size(row_boundaries) >= 2")
    boxed = grids.select(
        *KEYS, "group_no",
        F.element_at("column_boundaries", 1).alias("x0"), F.element_at("row_boundaries", 1).alias("y0"),
        F.element_at("column_boundaries", -1).alias("x1"), F.element_at("row_boundaries", -1).alias("y1"), "row_boundaries", "column_boundaries",
    )
    order = Window.partitionBy(*KEYS).orderBy(F.desc(Box.named().area), "group_no")
    return boxed.withColumn("grid_id", (F.row_number().over(order) - 1).cast("bigint")).select(*KEYS, "grid_id", "x0", "y0", "x1", "y1", "row_boundaries", "column_boundaries")


def grid_cells(grids: DataFrame) -> DataFrame:
    """One row per cell: ``grid_id, row, col`` and its box."""
    return grids.select(*KEYS, "grid_id", F.inline(cell_rects(F.col("row_boundaries"), F.col("column_boundaries"))))


def strips(grids: DataFrame, boundaries: str, name: str, low: str, high: str) -> DataFrame:
    """The rows or the columns of each grid, numbered from 0, with their two edges."""
    edges = F.col(boundaries)
    each = F.transform(
        F.slice(edges, 1, F.greatest(F.size(edges) - 1, F.lit(0))),
        lambda e, i: F.named_struct(F.lit(name), i, F.lit(low), e, F.lit(high), F.element_at(edges, i + 2)),
    )
    return grids.select(*KEYS, "grid_id", F.inline(each))


def assign_words(words: DataFrame, grids: DataFrame) -> DataFrame:
    """Each word in the cell that holds its centre, else in the one it overlaps most.

    Of equally good cells the lower, then the further right takes it. Words that meet
    no cell, or lack an edge, are left out. A word meets the rows of its page's grids in
    an equi-join, then the columns of those it touches, not every cell of the page.
    """
    rows, cols = strips(grids, "row_boundaries", "row", "c_y0", "c_y1"), strips(grids, "column_boundaries", "col", "c_x0", "c_x1")
    word, cell = Box.named(), Box.named("c_")
    w = words.select(*KEYS, "word_id", "text", "x0", "y0", "x1", "y1", "confidence")
    level = w.join(rows, KEYS).where((F.col("c_y0") <= F.col("y1")) & (F.col("c_y1") >= F.col("y0")))
    met = level.join(cols, [*KEYS, "grid_id"]).where((F.col("c_x0") <= F.col("x1")) & (F.col("c_x1") >= F.col("x0")))
    score = cell.overlap_ratio(word) + F.when(cell.holds_center_of(word), 2.0).otherwise(0.0)
    rated = met.withColumn("_score", score).where("_score > 0")
    best = F.max(F.struct("_score", "row", "col")).alias("_b")
    chosen = rated.groupBy(*KEYS, "grid_id", "word_id").agg(best, F.first(F.struct("text", "x0", "y0", "x1", "y1", "confidence")).alias("_w"))
    return chosen.select(*KEYS, "grid_id", "word_id", F.col("_b.row").alias("row"), F.col("_b.col").alias("col"), F.col("_b._score").alias("score"), "_w.*")


def words_on_grids(words: DataFrame, grids: DataFrame) -> DataFrame:
    """Words that touch any grid of their page."""
    g = grids.select(*KEYS, *(F.col(e).alias(f"g_{e}") for e in ("x0", "y0", "x1", "y1")))
    a, b = words.alias("w"), g.alias("g")
    same = (F.col("w.source_file") == F.col("g.source_file")) & (F.col("w.page_number") == F.col("g.page_number"))
    box = Box(*(F.col(f"w.{e}") for e in ("x0", "y0", "x1", "y1")))
    return a.join(b, same & box.intersects(Box.named("g_")), "leftsemi")


def resplit_lines(items: Column, tolerance: Column) -> Column:
    """Lines of words in reading order, split anew where a word leaves the first word of its line."""
    start = F.expr("cast(array() as array<struct<at:double,t:string>>)")

    def step(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(
            F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["at"].alias("at"), F.concat(last["t"], F.lit(" "), w["t"]).alias("t")))
        )
        fresh = F.concat(acc, F.array(F.struct(w["at"].alias("at"), w["t"].alias("t"))))
        return F.when((F.size(acc) == 0) | (F.abs(last["at"] - w["at"]) > tolerance), fresh).otherwise(longer)

    return F.transform(F.aggregate(items, start, step), lambda x: F.regexp_replace(x["t"], r"(?U)^\s+|\s+$", ""))


def cell_table(words: DataFrame, grids: DataFrame) -> DataFrame:
    """Every cell with its text and least confidence; cells without words are kept.

    Words are read line by line at the tolerance of the whole page, then split anew
    against the leftmost word of each line; a line that ends in a hyphen continues.
    """
    placed = assign_words(words, grids).join(cluster.page_tolerance(words), KEYS)
    keys = [*KEYS, "grid_id", "row", "col"]
    at = (F.col("y0") + F.col("y1")) / 2
    per = placed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(at.alias("at"), "x0", "word_id", "text"))).alias("_w"),
        F.min("confidence").alias("confidence"),
        F.first("tolerance").alias("_tol"),
    )
    per = per.withColumn("_anchors", cluster.anchors_of(F.transform("_w", lambda w: w["at"]), F.col("_tol")))
    reading = F.array_sort(
        F.transform(
            "_w",
            lambda w: F.struct(
                F.size(F.filter("_anchors", lambda a: a <= w["at"])).alias("line"), w["x0"].alias("x0"), w["at"].alias("at"),
                w["word_id"].alias("id"), w["text"].alias("t"),
            ),
        )
    )
    text = F.regexp_replace(cluster.joined_lines(resplit_lines(reading, F.col("_tol"))), r"(?U)^\s+|\s+$", "")
    low = F.regexp_replace(F.lower(text), r"(?U)\s+", " ")
    canonical = (
        F.when(low.rlike(r"^[^\w.]*inventar\s*ski broj[^\w.]*$"), "Inventarski broj").when(low.rlike(r"^[^\w.]*red\s*\.\s*broj[^\w.]*$"), "Red. broj").otherwise(text)
    )
    filled = per.select(*keys, canonical.alias("text"), "confidence")
    cells = grid_cells(grids)
    return cells.join(filled, keys, "left").withColumn("text", F.coalesce("text", F.lit("")))


def grid_use(placed: DataFrame) -> DataFrame:
    """By grid the ``populated`` cells and ``occupied_rows`` of words or cells with ``row``, ``col`` and ``text``.

    A cell has text if one of its words has, so none need be built.
    """
    used = placed.where(F.col("text").rlike(r"(?U)\S")).groupBy(*KEYS, "grid_id").agg(F.collect_set(F.struct("row", "col")).alias("_c"))
    return used.select(*KEYS, "grid_id", F.size("_c").cast("bigint").alias("populated"), F.size(F.array_distinct("_c.row")).cast("bigint").alias("occupied_rows"))


def grid_scores(placed: DataFrame, grids: DataFrame, pages: DataFrame) -> DataFrame:
    """How much a grid looks like a table, 0 to 1, with what the score is made of.

    ``placed`` has cells, or words in cells; ``pages`` has ``page_width`` and
    ``page_height``. Boxes of one row or column, or of less than a hundredth of the
    page, score 0.
    """
    use = grid_use(placed)
    n_rows, n_cols = boundary_count(F.col("row_boundaries")), boundary_count(F.col("column_boundaries"))
    share = Box.named().area / F.greatest(F.lit(1.0), F.col("page_width") * F.col("page_height"))
    one = F.lit(1.0)
    score = (
        F.least(one, n_rows / 4) * F.least(one, n_cols / 3) * 0.30
        + F.least(one, share / 0.08) * 0.25
        + F.col("populated") / F.greatest(n_rows * n_cols, F.lit(1)) * 0.25
        + F.col("occupied_rows") / F.greatest(n_rows, F.lit(1)) * 0.20
    )
    return (
        grids.join(use, [*KEYS, "grid_id"], "left")
        .fillna(0, ["populated", "occupied_rows"])
        .join(pages, KEYS)
        .select(
            *KEYS, "grid_id", n_rows.alias("n_rows"), n_cols.alias("n_cols"), "populated", "occupied_rows",
            F.when((n_rows < 2) | (n_cols < 2) | (share < 0.01), 0.0).otherwise(score).alias("score"), "x0", "y0",
        )
    )


def ruled_tables(cells: DataFrame, scores: DataFrame, minimum: float = 0.45) -> DataFrame:
    """Cells of credible grids, tables numbered from 1 from top to bottom and left to right."""
    order = Window.partitionBy(*KEYS).orderBy("y0", "x0", "grid_id")
    accepted = scores.where(F.col("score") >= minimum).withColumn("table_index", F.row_number().over(order).cast("bigint"))
    return cells.join(accepted.select(*KEYS, "grid_id", "table_index"), [*KEYS, "grid_id"]).select(
        *KEYS, "table_index", "row", "col", "text", "confidence"
    )


def form_grid(grids: DataFrame, pages: DataFrame) -> DataFrame:
    """The grid of each page that looks most like an equipment list, with its score.

    ``accepted`` says whether it has six columns and scores 0.65 or more. The first of
    equal grids, in the order of detection, is taken.
    """
    n_rows, n_cols = boundary_count(F.col("row_boundaries")), boundary_count(F.col("column_boundaries"))
    box = Box.named()
    score = (
        F.greatest(F.lit(0.0), 1 - F.abs(n_cols - 6) / 6) * 0.5
        + F.least(F.lit(1.0), n_rows / 20) * 0.25
        + F.least(F.lit(1.0), box.width / F.greatest(F.lit(1.0), F.col("page_width") * 0.75)) * 0.2
        + F.when(box.center_y > F.col("page_height") * 0.3, 1.0).otherwise(0.5) * 0.05
    )
    rated = grids.join(pages, KEYS).withColumn("score", score)
    best = Window.partitionBy(*KEYS).orderBy(F.desc("score"), "grid_id")
    return (
        rated.withColumn("_n", F.row_number().over(best))
        .where("_n = 1")
        .select(
            *KEYS, "grid_id", "x0", "y0", "x1", "y1", "row_boundaries", "column_boundaries", "score",
            ((n_cols == 6) & (F.col("score") >= 0.65)).alias("accepted"),
        )
    )


def clean_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without any text dropped; the numbers of the others stay."""
    row = Window.partitionBy(*keys, "row")
    return cells.withColumn("_any", F.max(F.length("text") > 0).over(row)).where("_any").drop("_any")
