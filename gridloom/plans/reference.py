"""Queries over the document tables, one or more for every operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.functions.geometry import Box, boundary_count, points_to_pixels, quarantine
from gridloom.operators import cluster, forms, grids, merge
from gridloom.plans import routing
from gridloom.session import cut_lineage, table
from gridloom.sinks import xlsx
from gridloom.sources import layout, raster
from gridloom.sources.layout import PAGE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
KEYS = list(PAGE)
TOLERANCE = 5.0


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return add


# Shared inputs -------------------------------------------------------------------------------


def words(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "words")


def lines(spark: SparkSession, base: str) -> DataFrame:
    return layout.ruled_lines(words(spark, base))


def found_grids(spark: SparkSession, base: str) -> DataFrame:
    """The grids of every page; the lines, some dozens a page, are laid once for all that is read from them."""
    return grids.detect_grids(cut_lineage(lines(spark, base)), TOLERANCE)


def steady(col, scale: int = 10_000):
    """Rounded by plain arithmetic, so that both engines agree on ties."""
    return F.floor(col * scale + 0.5) / scale


def page_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS).agg(F.max("x1").alias("page_width"), F.max("y1").alias("page_height"))


LINES = r"""
page AS (SELECT source_file, page_number, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM words GROUP BY 1, 2),
lines AS (
  SELECT source_file, page_number, CAST(k AS BIGINT) AS line_id, FALSE AS is_horizontal,
         ((x0 - 3) + (k // 2) * (((x1 - x0) + 6) / 6)) + ((k // 2) + page_number) % 2 AS start_x,
         CASE WHEN k % 2 = 0 THEN y0 - 4 ELSE (y0 + (y1 - y0) / 2) + 3 END AS start_y,
         ((x0 - 3) + (k // 2) * (((x1 - x0) + 6) / 6)) + ((k // 2) + page_number) % 2 AS end_x,
         CASE WHEN k % 2 = 0 THEN (y0 + (y1 - y0) / 2) - 3 ELSE y1 + 4 END AS end_y, 1.0 AS thickness
  FROM page, range(0, 14) AS r(k) WHERE x1 > x0 AND y1 > y0
  UNION ALL
  SELECT source_file, page_number, CAST(j + 1000 AS BIGINT), TRUE, x0 - 3,
         ((y0 - 4) + j * (((y1 - y0) + 8) / 12)) + ((j + page_number) % 2) * 0.5, x1 + 4,
         ((y0 - 4) + j * (((y1 - y0) + 8) / 12)) + ((j + page_number) % 2) * 0.5, 1.0
  FROM page, range(0, 13) AS r(j) WHERE x1 > x0 AND y1 > y0)"""
AXES = LINES + r""",
vvalues AS (SELECT source_file, page_number, start_x AS v, count(*) AS c FROM lines WHERE NOT is_horizontal GROUP BY 1, 2, 3),
vsteps AS (SELECT *, v - lag(v) OVER (PARTITION BY source_file, page_number ORDER BY v) AS gap FROM vvalues),
vgroups AS (SELECT *, sum(CASE WHEN gap > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY source_file, page_number ORDER BY v ROWS UNBOUNDED PRECEDING) AS g FROM vsteps),
xs AS (SELECT source_file, page_number, CAST(g AS BIGINT) AS cluster, sum(v * c) / sum(c) AS position, CAST(sum(c) AS BIGINT) AS n FROM vgroups GROUP BY 1, 2, 3),
hvalues AS (SELECT source_file, page_number, start_y AS v, count(*) AS c FROM lines WHERE is_horizontal GROUP BY 1, 2, 3),
hsteps AS (SELECT *, v - lag(v) OVER (PARTITION BY source_file, page_number ORDER BY v) AS gap FROM hvalues),
hgroups AS (SELECT *, sum(CASE WHEN gap > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY source_file, page_number ORDER BY v ROWS UNBOUNDED PRECEDING) AS g FROM hsteps),
ys AS (SELECT source_file, page_number, CAST(g AS BIGINT) AS cluster, sum(v * c) / sum(c) AS position, CAST(sum(c) AS BIGINT) AS n FROM hgroups GROUP BY 1, 2, 3)"""
GROUPS = AXES + r""",
pairs AS (SELECT *, lag(position) OVER (PARTITION BY source_file, page_number ORDER BY position) AS prev FROM xs),
flags AS (
  SELECT p.source_file, p.page_number, p.position,
         CASE WHEN p.prev IS NOT NULL AND NOT EXISTS (
           SELECT 1 FROM lines l WHERE l.is_horizontal AND l.source_file = p.source_file AND l.page_number = p.page_number
             AND l.start_x <= p.prev + 5 AND l.end_x >= p.position - 5) THEN 1 ELSE 0 END AS cut
  FROM pairs p),
groups AS (SELECT source_file, page_number, position, CAST(sum(cut) OVER (PARTITION BY source_file, page_number ORDER BY position ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM flags),
extent AS (SELECT source_file, page_number, group_no, min(position) AS lo, max(position) AS hi, count(*) AS n FROM groups GROUP BY 1, 2, 3 HAVING count(*) >= 2),
kept AS (
  SELECT DISTINCT e.source_file, e.page_number, e.group_no, y.position AS row_y
  FROM extent e JOIN ys y USING (source_file, page_number)
  JOIN lines l ON l.is_horizontal AND l.source_file = e.source_file AND l.page_number = e.page_number
  WHERE abs(y.position - l.start_y) <= 5 AND l.start_x <= e.lo + 5 AND l.end_x >= e.hi - 5)"""
GRIDS = GROUPS + r""",
colb AS (SELECT source_file, page_number, group_no, list(position ORDER BY position) AS cb FROM groups GROUP BY 1, 2, 3),
rowb AS (SELECT source_file, page_number, group_no, list(row_y ORDER BY row_y) AS rb FROM kept GROUP BY 1, 2, 3),
boxed AS (SELECT source_file, page_number, group_no, cb, rb, cb[1] AS x0, rb[1] AS y0, cb[-1] AS x1, rb[-1] AS y1
          FROM colb JOIN rowb USING (source_file, page_number, group_no) WHERE len(cb) >= 2 AND len(rb) >= 2),
grids AS (SELECT *, row_number() OVER (PARTITION BY source_file, page_number ORDER BY (x1 - x0) * (y1 - y0) DESC, group_no) - 1 AS grid_id FROM boxed),
cells AS (
  SELECT source_file, page_number, grid_id, r.i - 1 AS row, c.j - 1 AS col, cb[c.j] AS x0, rb[r.i] AS y0, cb[c.j + 1] AS x1, rb[r.i + 1] AS y1
  FROM grids, range(1, 200) AS r(i), range(1, 200) AS c(j) WHERE r.i < len(rb) AND c.j < len(cb))"""
PLACED = GRIDS + r""",
rated AS (
  SELECT w.source_file, w.page_number, c.grid_id, w.word_id, c.row, c.col, w.text, w.x0, w.y0, w.x1, w.y1, w.confidence,
         CASE WHEN least((w.x1 - w.x0) * (w.y1 - w.y0), (c.x1 - c.x0) * (c.y1 - c.y0)) > 0
              THEN (least(w.x1, c.x1) - greatest(w.x0, c.x0)) * (least(w.y1, c.y1) - greatest(w.y0, c.y0))
                   / least((w.x1 - w.x0) * (w.y1 - w.y0), (c.x1 - c.x0) * (c.y1 - c.y0)) ELSE 0 END
         + CASE WHEN (w.x0 + w.x1) / 2 BETWEEN c.x0 AND c.x1 AND (w.y0 + w.y1) / 2 BETWEEN c.y0 AND c.y1 THEN 2 ELSE 0 END AS score
  FROM words w JOIN cells c ON w.source_file = c.source_file AND w.page_number = c.page_number
   AND w.x0 <= c.x1 AND w.x1 >= c.x0 AND w.y0 <= c.y1 AND w.y1 >= c.y0),
placed AS (
  SELECT * FROM rated WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY source_file, page_number, grid_id, word_id ORDER BY score DESC, row DESC, col DESC) = 1)"""


def with_(ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ctes.strip() + "\n" + select


# Scans and pages -----------------------------------------------------------------------------


@query(
    "s02_page_selection",
    "WITH p AS (SELECT DISTINCT source_file, page_number FROM words), a AS (SELECT * FROM (VALUES (0, 2), (1, 1), (2, 2)) AS v(position, page_number)) "
    "SELECT source_file, CAST(page_number AS BIGINT) AS page_number, CAST(position AS BIGINT) AS position FROM p JOIN a USING (page_number)",
)
def s02(spark, base):
    return routing.select_pages(words(spark, base).select(*KEYS).distinct(), (2, 1, 2)).select(*KEYS, "position")


@query(
    "s04_rectangle_edges",
    "SELECT source_file, page_number, count(*) * 4 AS n_lines, round(sum(2 * (x1 - x0) + 2 * (y1 - y0)), 2) AS length FROM words GROUP BY 1, 2",
)
def s04(spark, base):
    edge = lambda a, b, c, d: F.struct(F.col(a).alias("ax"), F.col(b).alias("ay"), F.col(c).alias("bx"), F.col(d).alias("by"))
    four = F.array(edge("x0", "y0", "x1", "y0"), edge("x0", "y1", "x1", "y1"), edge("x0", "y0", "x0", "y1"), edge("x1", "y0", "x1", "y1"))
    each = words(spark, base).select(*KEYS, F.inline(four))
    span = F.abs(F.col("bx") - F.col("ax")) + F.abs(F.col("by") - F.col("ay"))
    return each.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(span), 2).alias("length"))


ANALYSIS = r"""
s AS (
  SELECT source_file, page_number, CAST(coalesce(sum(length(regexp_replace(text, '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g'))), 0) AS BIGINT) AS character_count,
         count(*) AS word_count, count(*) FILTER (regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]')) AS usable,
         sum((x1 - x0) * (y1 - y0)) AS word_area, (max(x1) - min(x0)) * (max(y1) - min(y0)) AS page_area,
         count(*) FILTER (source = 'ocr') AS n_ocr
  FROM words GROUP BY 1, 2),
a AS (
  SELECT source_file, page_number, character_count, word_count,
         CASE WHEN page_area > 0 THEN least(1.0, word_area / page_area) ELSE 0 END AS text_coverage,
         CASE WHEN page_area > 0 AND n_ocr > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS image_coverage, usable / word_count AS usable_word_ratio
  FROM s),
analysis AS (
  SELECT *, CASE WHEN character_count >= 20 AND word_count >= 4 AND usable_word_ratio >= 0.55
                 THEN CASE WHEN image_coverage >= 0.45 THEN 'mixed' ELSE 'digital' END ELSE 'scanned' END AS page_type FROM a)"""


@query(
    "s05_page_analysis",
    with_(ANALYSIS, "SELECT source_file, page_number, character_count, word_count, round(text_coverage, 4) AS text_coverage, image_coverage, round(usable_word_ratio, 4) AS usable_word_ratio, page_type FROM analysis"),
)
def s05(spark, base):
    return layout.page_analysis(words(spark, base)).withColumns({c: F.round(c, 4) for c in ("text_coverage", "usable_word_ratio")})


@query("g11_render_metrics")
def g11(spark, base):
    return raster.draw_pages(words(spark, base), kernel=raster.METRICS)


@query("i07_raster_rules")
def i07(spark, base):
    return raster.draw_pages(words(spark, base), kernel=raster.rules_kernel(0.02))


@query("j08_words_with_ink")
def j08(spark, base):
    return raster.words_with_ink(words(spark, base))


# Geometry ------------------------------------------------------------------------------------

PAGE_BOX = "c AS (SELECT source_file, page_number, min(x0) + (max(x1) - min(x0)) / 4 AS x0, min(y0) + (max(y1) - min(y0)) / 4 AS y0, max(x1) - (max(x1) - min(x0)) / 4 AS x1, max(y1) - (max(y1) - min(y0)) / 4 AS y1 FROM words GROUP BY 1, 2)"


def with_middle(spark, base) -> tuple[DataFrame, Box, Box]:
    """Words beside the middle half of their page."""
    w = words(spark, base)
    e = layout.page_extents(w)
    dx, dy = (F.col("x1") - F.col("x0")) / 4, (F.col("y1") - F.col("y0")) / 4
    middle = e.select(*KEYS, (F.col("x0") + dx).alias("c_x0"), (F.col("y0") + dy).alias("c_y0"), (F.col("x1") - dx).alias("c_x1"), (F.col("y1") - dy).alias("c_y1"))
    return w.join(middle, KEYS), Box.named(), Box.named("c_")


@query("p01_box_metrics", "SELECT word_id, x1 - x0 AS width, y1 - y0 AS height, (x0 + x1) / 2 AS center_x, (y0 + y1) / 2 AS center_y FROM words")
def p01(spark, base):
    b = Box.named()
    return words(spark, base).select("word_id", b.width.alias("width"), b.height.alias("height"), b.center_x.alias("center_x"), b.center_y.alias("center_y"))


@query(
    "p02_box_intersection",
    f"WITH {PAGE_BOX} SELECT word_id, greatest(w.x0, c.x0) AS x0, greatest(w.y0, c.y0) AS y0, least(w.x1, c.x1) AS x1, least(w.y1, c.y1) AS y1 "
    "FROM words w JOIN c USING (source_file, page_number) WHERE least(w.x1, c.x1) >= greatest(w.x0, c.x0) AND least(w.y1, c.y1) >= greatest(w.y0, c.y0)",
)
def p02(spark, base):
    df, w, c = with_middle(spark, base)
    return df.where(w.intersects(c)).select("word_id", *w.meet(c).columns())


@query(
    "p03_box_contains",
    f"WITH {PAGE_BOX} SELECT source_file, page_number, count(*) AS n FROM words w JOIN c USING (source_file, page_number) WHERE c.x0 <= w.x0 AND c.y0 <= w.y0 AND c.x1 >= w.x1 AND c.y1 >= w.y1 GROUP BY 1, 2",
)
def p03(spark, base):
    df, w, c = with_middle(spark, base)
    return df.where(c.contains(w)).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p04_overlap_ratio",
    f"WITH {PAGE_BOX} SELECT word_id, floor((CASE WHEN least(w.x1, c.x1) >= greatest(w.x0, c.x0) AND least(w.y1, c.y1) >= greatest(w.y0, c.y0) AND least((w.x1 - w.x0) * (w.y1 - w.y0), (c.x1 - c.x0) * (c.y1 - c.y0)) > 0 "
    "THEN (least(w.x1, c.x1) - greatest(w.x0, c.x0)) * (least(w.y1, c.y1) - greatest(w.y0, c.y0)) / least((w.x1 - w.x0) * (w.y1 - w.y0), (c.x1 - c.x0) * (c.y1 - c.y0)) ELSE 0 END) * 10000 + 0.5) / 10000 AS ratio "
    "FROM words w JOIN c USING (source_file, page_number)",
)
def p04(spark, base):
    df, w, c = with_middle(spark, base)
    return df.select("word_id", steady(w.overlap_ratio(c)).alias("ratio"))


@query(
    "p05_scaled_words",
    "SELECT word_id, round(x0 * 0.24, 4) AS x0, round(y0 * 0.24, 4) AS y0, round(x1 * 0.24, 4) AS x1, round(y1 * 0.24, 4) AS y1 FROM words WHERE coord_space = 'pixels'",
)
def p05(spark, base):
    b = Box.named().scaled(0.24, 0.24)
    return words(spark, base).where("coord_space = 'pixels'").select("word_id", *(F.round(c, 4).alias(n) for c, n in ((b.x0, "x0"), (b.y0, "y0"), (b.x1, "x1"), (b.y1, "y1"))))


@query(
    "p06_points_to_pixels",
    "SELECT word_id, round(x0 * (2480 / 595.0), 3) AS x0, round(y0 * (3508 / 842.0), 3) AS y0, round(x1 * (2480 / 595.0), 3) AS x1, round(y1 * (3508 / 842.0), 3) AS y1 FROM words WHERE coord_space = 'points'",
)
def p06(spark, base):
    b = points_to_pixels(Box.named(), F.lit(595.0), F.lit(842.0), F.lit(2480), F.lit(3508))
    return words(spark, base).where("coord_space = 'points'").select("word_id", *(F.round(c, 3).alias(n) for c, n in ((b.x0, "x0"), (b.y0, "y0"), (b.x1, "x1"), (b.y1, "y1"))))


@query("p07_inverted_boxes", "SELECT word_id FROM words WHERE NOT coalesce(x1 >= x0 AND y1 >= y0, FALSE)")
def p07(spark, base):
    return quarantine(words(spark, base))[1].select("word_id")


@query("p08_cell_boxes", with_(GRIDS, "SELECT source_file, page_number, grid_id, row, col, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1 FROM cells"))
def p08(spark, base):
    return grids.grid_cells(found_grids(spark, base)).withColumns({c: F.round(c, 4) for c in ("x0", "y0", "x1", "y1")})


@query("p09_grid_size", with_(GRIDS, "SELECT source_file, page_number, grid_id, len(rb) - 1 AS n_rows, len(cb) - 1 AS n_cols FROM grids"))
def p09(spark, base):
    return found_grids(spark, base).select(*KEYS, "grid_id", boundary_count(F.col("row_boundaries")).alias("n_rows"), boundary_count(F.col("column_boundaries")).alias("n_cols"))


@query("p10_borderless_table")
def p10(spark, base):
    return cluster.legacy_rows(words(spark, base)).select(*KEYS, F.col("row_no").alias("row"), F.col("col_no").alias("col"), "text")


# Filters -------------------------------------------------------------------------------------


@query("f01_nonblank_words", r"SELECT source_file, page_number, count(*) AS n FROM words WHERE regexp_matches(coalesce(text, ''), '[^\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]') GROUP BY 1, 2")
def f01(spark, base):
    return words(spark, base).where(~T.is_blank(F.col("text"))).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


@query("f02_confident_words", "SELECT word_id FROM words WHERE source = 'ocr' AND text IS NOT NULL AND trim(text) <> '' AND confidence >= 0.35")
def f02(spark, base):
    return routing.usable_words(words(spark, base).where("source = 'ocr'")).select("word_id")


@query("f03_usable_words", r"SELECT source_file, page_number, count(*) AS n FROM words WHERE regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]') GROUP BY 1, 2")
def f03(spark, base):
    return words(spark, base).where(T.has_alphanumeric(F.col("text"))).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f04_long_rules",
    with_(LINES, "SELECT l.source_file, l.page_number, count(*) AS n FROM lines l JOIN page p USING (source_file, page_number) WHERE CASE WHEN is_horizontal THEN end_x - start_x >= 0.08 * p.x1 ELSE end_y - start_y >= 0.08 * p.y1 END GROUP BY 1, 2"),
)
def f04(spark, base):
    size = page_sizes(words(spark, base))
    long = F.when(F.col("is_horizontal"), F.col("end_x") - F.col("start_x") >= F.col("page_width") * 0.08).otherwise(F.col("end_y") - F.col("start_y") >= F.col("page_height") * 0.08)
    return lines(spark, base).join(size, KEYS).where(long).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f05_rule_artifacts",
    r"""WITH v AS (SELECT item_id, f.n AS field_name, confidence, regexp_replace(coalesce(f.v, ''), '^[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g') AS v
  FROM equipment, LATERAL (VALUES ('item_number', item_number), ('equipment_type', equipment_type), ('model', model), ('quantity', quantity), ('serial_number', serial_number), ('inventory_number', inventory_number)) AS f(n, v))
SELECT item_id, field_name FROM v WHERE v <> '' AND (regexp_full_match(v, '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}|_—–.\-·]+') OR v IN ('|I', 'I|', '||I', 'I||')
  OR (length(regexp_replace(v, '[^|_—–.\-·]', '', 'g')) / length(v) >= 0.7 AND (confidence IS NULL OR confidence < 0.6)))""",
)
def f05(spark, base):
    fields = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("v")) for f in forms.ITEM_FIELDS))
    each = table(spark, base, "equipment").select("item_id", "confidence", F.inline(fields))
    return each.where(T.is_rule_artifact(F.col("v"), F.col("confidence"))).select("item_id", "field_name")


@query(
    "f06_populated_items",
    r"SELECT item_id FROM equipment WHERE regexp_matches(concat(equipment_type, model, quantity, serial_number, inventory_number), '[^\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')",
)
def f06(spark, base):
    return table(spark, base, "equipment").where(forms.populated()).select("item_id")


#: What is stripped from the ends of a text, as a class of both engines.
STRIPPED = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x{001c}-\x{001f}]"
BAND = GRIDS + r""",
g AS (SELECT * FROM grids WHERE grid_id = 0),
bottom AS (SELECT source_file, page_number, max(y1) AS b FROM words GROUP BY 1, 2),
hg AS (SELECT source_file, page_number, x0, y0 + (y1 - y0) * 0.4 AS y0, x1, y1 FROM g),
band AS (
  SELECT w.*, hg.x0 AS gx0, hg.x1 AS gx1, hg.y0 AS gy0, (w.x0 + w.x1) / 2 AS cx, (w.y0 + w.y1) / 2 AS cy,
         contains(lower(text), 'prezime') OR contains(lower(text), 'ime') OR contains(lower(text), 'naziv') OR contains(lower(text), 'organizacione') OR contains(lower(text), 'jedinice') AS label
  FROM words w JOIN hg USING (source_file, page_number) JOIN bottom USING (source_file, page_number)
  WHERE (w.y0 + w.y1) / 2 >= hg.y0 - greatest((hg.y1 - hg.y0) * 0.18, b * 0.08) AND (w.y0 + w.y1) / 2 < hg.y0)"""


def form_area(spark, base) -> DataFrame:
    """The largest grid of each page from 0.4 of its height on, where the item rows of a form begin."""
    g = found_grids(spark, base).where("grid_id = 0")
    return g.withColumn("y0", F.col("y0") + (F.col("y1") - F.col("y0")) * 0.4)


def header_band(spark, base) -> DataFrame:
    w, g = words(spark, base), form_area(spark, base)
    b = Box.named()
    edges = g.select(*KEYS, *(F.col(e).alias(f"g_{e}") for e in ("x0", "y0", "x1", "y1")))
    bottom = w.groupBy(*KEYS).agg(F.max("y1").alias("_bottom"))
    reach = F.greatest((F.col("g_y1") - F.col("g_y0")) * 0.18, F.col("_bottom") * 0.08)
    return w.join(edges, KEYS).join(bottom, KEYS).where((b.center_y >= F.col("g_y0") - reach) & (b.center_y < F.col("g_y0")))


@query("f11_header_band", with_(BAND, "SELECT word_id FROM band"))
def f11(spark, base):
    return header_band(spark, base).select("word_id")


@query("f12_label_words", "SELECT word_id FROM words WHERE contains(lower(text), 'prezime') OR contains(lower(text), 'ime') OR contains(lower(text), 'naziv') OR contains(lower(text), 'organizacione') OR contains(lower(text), 'jedinice')")
def f12(spark, base):
    return words(spark, base).where(T.is_label(F.col("text"))).select("word_id")


@query(
    "f13_f14_header_values",
    with_(BAND, ", level AS (SELECT source_file, page_number, avg(cy) AS ly FROM band WHERE label GROUP BY 1, 2)\n"
    "SELECT word_id, CASE WHEN (cx - gx0) / nullif(gx1 - gx0, 0) < 0.48 THEN 'person' WHEN (cx - gx0) / nullif(gx1 - gx0, 0) < 0.68 THEN 'identifier' ELSE 'unit' END AS region "
    "FROM band JOIN level USING (source_file, page_number) WHERE NOT label AND cy < ly - greatest(1.0, (y1 - y0) * 0.15)"),
)
def f13(spark, base):
    b = Box.named()
    near = header_band(spark, base).withColumn("_label", T.is_label(F.col("text")))
    level = near.where("_label").groupBy(*KEYS).agg(F.avg(b.center_y).alias("_level"))
    place = (b.center_x - F.col("g_x0")) / F.nullif(F.col("g_x1") - F.col("g_x0"), F.lit(0.0))
    region = F.when(place < 0.48, "person").when(place < 0.68, "identifier").otherwise("unit")
    return near.where("NOT _label").join(level, KEYS).where(b.center_y < F.col("_level") - F.greatest(F.lit(1.0), b.height * 0.15)).select("word_id", region.alias("region"))


@query("f15_footer_words", with_(GRIDS, "SELECT word_id FROM words w JOIN (SELECT source_file, page_number, y0 + (y1 - y0) * 0.8 AS foot FROM grids WHERE grid_id = 0) g USING (source_file, page_number) WHERE (w.y0 + w.y1) / 2 > foot"))
def f15(spark, base):
    g = found_grids(spark, base).where("grid_id = 0").select(*KEYS, (F.col("y0") + (F.col("y1") - F.col("y0")) * 0.8).alias("foot"))
    return words(spark, base).join(g, KEYS).where(Box.named().center_y > F.col("foot")).select("word_id")


@query("f09_phantom_candidates", with_(GRIDS, "SELECT word_id FROM words w JOIN grids g USING (source_file, page_number) WHERE grid_id = 0 AND w.source = 'native' AND length(trim(text)) = 1 AND NOT regexp_full_match(text, '[0-9]+') AND (w.y0 + w.y1) / 2 > g.y0 AND (w.y0 + w.y1) / 2 < g.y1"))
def f09(spark, base):
    g = found_grids(spark, base).where("grid_id = 0").select(*KEYS, F.col("y0").alias("g0"), F.col("y1").alias("g1"))
    cheap = words(spark, base).where((F.col("source") == "native") & (F.length(F.trim("text")) == 1) & ~F.col("text").rlike("^[0-9]+$"))
    cy = Box.named().center_y
    return cheap.join(g, KEYS).where((cy > F.col("g0")) & (cy < F.col("g1"))).select("word_id")


# Joins ---------------------------------------------------------------------------------------


@query("j01_word_cells", with_(PLACED, "SELECT word_id, grid_id, row, col, floor(score * 10000 + 0.5) / 10000 AS score FROM placed"))
def j01(spark, base):
    return grids.assign_words(words(spark, base), found_grids(spark, base)).select("word_id", "grid_id", "row", "col", steady(F.col("score")).alias("score"))


@query("j02_words_on_grids", with_(GRIDS, "SELECT word_id FROM words w WHERE EXISTS (SELECT 1 FROM grids g WHERE g.source_file = w.source_file AND g.page_number = w.page_number AND w.x0 <= g.x1 AND w.x1 >= g.x0 AND w.y0 <= g.y1 AND w.y1 >= g.y0)"))
def j02(spark, base):
    return grids.words_on_grids(words(spark, base), found_grids(spark, base)).select("word_id")


@query("j03_merged_words")
def j03(spark, base):
    merged, _ = merge.merge_words(merge.second_reading(words(spark, base)))
    return merged.select(*KEYS, "position", "word_id", "text", "source")


@query("j03_disagreements")
def j03b(spark, base):
    return merge.merge_words(merge.second_reading(words(spark, base)))[1]


@query("j04_spanning_rows", with_(GROUPS, "SELECT source_file, page_number, group_no, round(row_y, 4) AS row_y FROM kept"))
def j04(spark, base):
    ls = layout.oriented(lines(spark, base))
    h, v = ls.where("is_horizontal"), ls.where("NOT is_horizontal")
    groups = grids.continuous_groups(cluster.axis_clusters(v, KEYS, "start_x", TOLERANCE).select(*KEYS, "position"), h, TOLERANCE)
    rows = cluster.axis_clusters(h, KEYS, "start_y", TOLERANCE).select(*KEYS, "position")
    return grids.spanning_rows(groups, rows, h, TOLERANCE).withColumn("row_y", F.round("row_y", 4))


@query(
    "j05_c02_continuous_groups",
    with_(GROUPS, "SELECT source_file, page_number, round(position, 4) AS position, group_no FROM groups"),
)
def j05(spark, base):
    ls = layout.oriented(lines(spark, base))
    h, v = ls.where("is_horizontal"), ls.where("NOT is_horizontal")
    groups = grids.continuous_groups(cluster.axis_clusters(v, KEYS, "start_x", TOLERANCE).select(*KEYS, "position"), h, TOLERANCE)
    return groups.withColumn("position", F.round("position", 4))


FORM_ITEMS = "SELECT f.form_id, e.item_id, f.source_file, f.page_number, f.person_name, e.serial_number, e.inventory_number FROM forms f JOIN equipment e USING (source_file, page_number)"


@query("j07_form_items", FORM_ITEMS)
def j07(spark, base):
    f = table(spark, base, "forms").select("form_id", *KEYS, "person_name")
    e = table(spark, base, "equipment").select("item_id", *KEYS, "serial_number", "inventory_number")
    return f.join(e, KEYS).select("form_id", "item_id", *KEYS, "person_name", "serial_number", "inventory_number")


@query("j07_form_warnings", "SELECT f.form_id, w.warning_id, w.code, w.severity FROM forms f JOIN conversion_warnings w USING (source_file, page_number)")
def j07b(spark, base):
    f = table(spark, base, "forms").select("form_id", *KEYS)
    return f.join(table(spark, base, "conversion_warnings"), KEYS).select("form_id", "warning_id", "code", "severity")


# Clusters ------------------------------------------------------------------------------------


@query("c01_axis_clusters", with_(AXES, "SELECT source_file, page_number, cluster, round(position, 4) AS position, n FROM xs"))
def c01(spark, base):
    return cluster.axis_clusters(lines(spark, base).where("NOT is_horizontal"), KEYS, "start_x", TOLERANCE).withColumn("position", F.round("position", 4))


def scan_sql(at: str, tolerance: str, inner: str) -> str:
    """A first-fit scan in SQL: one step a word, all pages at once."""
    return f"""
tol AS (SELECT source_file, page_number, {tolerance} AS t FROM words GROUP BY 1, 2),
seq AS (SELECT source_file, page_number, word_id, text, x0, {at} AS pos, t, row_number() OVER (PARTITION BY source_file, page_number ORDER BY {at}, x0, word_id) AS rn FROM words JOIN tol USING (source_file, page_number)),
scan AS (
  SELECT source_file, page_number, rn, word_id, text, x0, pos, pos AS anchor, 0 AS line_no FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.source_file, s.page_number, s.rn, s.word_id, s.text, s.x0, s.pos,
         CASE WHEN s.pos - p.anchor > s.t THEN s.pos ELSE p.anchor END, CASE WHEN s.pos - p.anchor > s.t THEN p.line_no + 1 ELSE p.line_no END
  FROM scan p JOIN seq s ON s.source_file = p.source_file AND s.page_number = p.page_number AND s.rn = p.rn + 1),
read AS (SELECT *, row_number() OVER (PARTITION BY source_file, page_number, line_no ORDER BY {inner}) - 1 AS place FROM scan)"""


MEDIAN = "coalesce(greatest(1.0, median(CASE WHEN y1 - y0 > 0 THEN y1 - y0 END) * 0.55), 2.0)"


@query("c03_reading_order", with_(scan_sql("(y0 + y1) / 2", MEDIAN, "x0, pos, word_id"), "SELECT source_file, page_number, word_id, CAST(line_no AS BIGINT) AS line_no, place FROM read"))
def c03(spark, base):
    w = words(spark, base)
    return cluster.text_lines(w.join(cluster.page_tolerance(w), KEYS), KEYS, F.col("tolerance")).select(*KEYS, "word_id", "line_no", "place")


@query("c07_word_rows", with_(scan_sql("y0", "4.0", "pos, x0, word_id"), "SELECT source_file, page_number, word_id, CAST(line_no AS BIGINT) AS line_no, place FROM read"))
def c07(spark, base):
    return cluster.text_lines(words(spark, base), KEYS, 4.0, along="top").select(*KEYS, "word_id", "line_no", "place")


@query("c04_cell_text")
def c04(spark, base):
    return grids.cell_table(words(spark, base), found_grids(spark, base)).where("text <> ''").select(*KEYS, "grid_id", "row", "col", "text", "confidence")


@query("c05_legacy_rows")
def c05(spark, base):
    return cluster.legacy_rows(words(spark, base))


@query("c06_legacy_text")
def c06(spark, base):
    return cluster.legacy_cell_text(cluster.legacy_rows(words(spark, base)), KEYS)


@query("c08_merged_rules")
def c08(spark, base):
    return cluster.merge_collinear(lines(spark, base))


@query("c09_footer_lines")
def c09(spark, base):
    g = found_grids(spark, base).where("grid_id = 0").select(*KEYS, (F.col("y0") + (F.col("y1") - F.col("y0")) * 0.8).alias("foot"))
    below = words(spark, base).join(g, KEYS).where(Box.named().center_y > F.col("foot")).drop("foot")
    return cluster.line_text(cluster.footer_lines(below), KEYS)


@query("c10_page_tolerance", f"SELECT source_file, page_number, round({MEDIAN}, 4) AS tolerance FROM words GROUP BY 1, 2")
def c10(spark, base):
    return cluster.page_tolerance(words(spark, base)).withColumn("tolerance", F.round("tolerance", 4))


# Grids, scores, forms ------------------------------------------------------------------------


@query("g01_grids", with_(GRIDS, "SELECT source_file, page_number, grid_id, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1, round(list_sum(rb), 3) AS rows_sum, round(list_sum(cb), 3) AS cols_sum FROM grids"))
def g01(spark, base):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 3)
    return found_grids(spark, base).select(*KEYS, "grid_id", *(F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")), total("row_boundaries").alias("rows_sum"), total("column_boundaries").alias("cols_sum"))


SIZE = "size AS (SELECT source_file, page_number, max(x1) AS pw, max(y1) AS ph FROM words GROUP BY 1, 2)"
FORM_SCORE = (
    "0.5 * greatest(0.0, 1 - abs(len(cb) - 1 - 6) / 6) + 0.25 * least(1.0, (len(rb) - 1) / 20) + 0.2 * least(1.0, (g.x1 - g.x0) / greatest(1.0, pw * 0.75))"
    " + 0.05 * CASE WHEN (g.y0 + g.y1) / 2 > ph * 0.3 THEN 1.0 ELSE 0.5 END"
)


@query(
    "g02_form_grid",
    with_(GRIDS, f", {SIZE}, sc AS (SELECT g.*, {FORM_SCORE} AS score FROM grids g JOIN size USING (source_file, page_number))\n"
    "SELECT source_file, page_number, grid_id, round(score, 4) AS score, len(cb) - 1 = 6 AND score >= 0.65 AS accepted FROM sc QUALIFY row_number() OVER (PARTITION BY source_file, page_number ORDER BY score DESC, grid_id) = 1"),
)
def g02(spark, base):
    best = grids.form_grid(found_grids(spark, base), page_sizes(words(spark, base)))
    return best.select(*KEYS, "grid_id", F.round("score", 4).alias("score"), "accepted")


SCORES = PLACED + f""", {SIZE},
filled AS (SELECT source_file, page_number, grid_id, count(DISTINCT row * 1000 + col) AS populated, count(DISTINCT row) AS occupied_rows FROM placed WHERE trim(text) <> '' GROUP BY 1, 2, 3),
scored AS (
  SELECT g.source_file, g.page_number, g.grid_id, len(rb) - 1 AS n_rows, len(cb) - 1 AS n_cols, coalesce(populated, 0) AS populated, coalesce(occupied_rows, 0) AS occupied_rows, g.x0, g.y0,
         CASE WHEN len(rb) < 3 OR len(cb) < 3 OR (g.x1 - g.x0) * (g.y1 - g.y0) / greatest(1.0, pw * ph) < 0.01 THEN 0
         ELSE 0.30 * least(1.0, (len(rb) - 1) / 4) * least(1.0, (len(cb) - 1) / 3) + 0.25 * least(1.0, (g.x1 - g.x0) * (g.y1 - g.y0) / greatest(1.0, pw * ph) / 0.08)
            + 0.25 * coalesce(populated, 0) / ((len(rb) - 1) * (len(cb) - 1)) + 0.20 * coalesce(occupied_rows, 0) / (len(rb) - 1) END AS score
  FROM grids g JOIN size USING (source_file, page_number) LEFT JOIN filled f ON f.source_file = g.source_file AND f.page_number = g.page_number AND f.grid_id = g.grid_id)"""


def scored_grids(spark, base) -> tuple[DataFrame, DataFrame]:
    w, g = words(spark, base), cut_lineage(found_grids(spark, base))
    return grids.cell_table(w, g), grids.grid_scores(grids.assign_words(w, g), g, page_sizes(w))


@query("g03_grid_scores", with_(SCORES, "SELECT source_file, page_number, grid_id, n_rows, n_cols, populated, occupied_rows, round(score, 4) AS score FROM scored"))
def g03(spark, base):
    return scored_grids(spark, base)[1].select(*KEYS, "grid_id", "n_rows", "n_cols", "populated", "occupied_rows", F.round("score", 4).alias("score"))


@query(
    "g04_f08_c11_ruled_tables",
    with_(SCORES, ", t AS (SELECT *, row_number() OVER (PARTITION BY source_file, page_number ORDER BY y0, x0, grid_id) AS table_index FROM scored WHERE score >= 0.45)\nSELECT source_file, page_number, table_index, n_rows * n_cols AS n_cells, populated AS n_filled FROM t"),
)
def g04(spark, base):
    cells, scores = scored_grids(spark, base)
    t = grids.ruled_tables(cells, scores)
    return t.groupBy(*KEYS, "table_index").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("text") != "").alias("n_filled"))


@query("f07_t09_clean_tables")
def f07(spark, base):
    cells, scores = scored_grids(spark, base)
    return grids.clean_tables(grids.ruled_tables(cells, scores), [*KEYS, "table_index"]).withColumn("text", T.normalize_text(F.col("text")))


@query("g05_f10_template_match")
def g05(spark, base):
    return forms.match_templates(forms.page_text(words(spark, base)))


def _form_cells(spark, base) -> tuple[DataFrame, DataFrame]:
    g = form_area(spark, base)
    rows = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.col("y0") + i * ((F.col("y1") - F.col("y0")) / 8))
    g = g.withColumn("row_boundaries", rows)
    return g, grids.cell_table(words(spark, base), g)


@query("g06_j06_equipment_rows")
def g06(spark, base):
    return forms.equipment_rows(_form_cells(spark, base)[1])


@query("f19_header_warnings")
def f19(spark, base):
    return forms.header_warnings(_form_cells(spark, base)[1])


@query(
    "g07_header_fields",
    with_(BAND, rf""", level AS (SELECT source_file, page_number, avg(cy) AS ly FROM band WHERE label GROUP BY 1, 2),
vals AS (
  SELECT source_file, page_number, word_id, x0, CASE WHEN (cx - gx0) / nullif(gx1 - gx0, 0) < 0.48 THEN 'p' WHEN (cx - gx0) / nullif(gx1 - gx0, 0) < 0.68 THEN 'i' ELSE 'u' END AS region,
         nullif(regexp_replace(text, '^{STRIPPED}+|{STRIPPED}+$', '', 'g'), '') AS t
  FROM band JOIN level USING (source_file, page_number) WHERE NOT label AND cy < ly - greatest(1.0, (y1 - y0) * 0.15))
SELECT source_file, page_number, coalesce(string_agg(t, ' ' ORDER BY x0, word_id) FILTER (region = 'p'), '') AS person_name,
       regexp_replace(coalesce(string_agg(t, ' ' ORDER BY x0, word_id) FILTER (region = 'i'), ''), '[^0-9]', '', 'g') AS person_identifier,
       coalesce(string_agg(t, ' ' ORDER BY x0, word_id) FILTER (region = 'u'), '') AS organization_unit
FROM vals GROUP BY 1, 2"""),
)
def g07(spark, base):
    return forms.header_fields(words(spark, base), form_area(spark, base))


@query("g08_footer_fields")
def g08(spark, base):
    g = found_grids(spark, base).where("grid_id = 0").withColumn("y1", F.col("y0") + (F.col("y1") - F.col("y0")) * 0.8)
    return forms.footer_fields(words(spark, base), g)[0]


@query(
    "g10_run_counters",
    with_(ANALYSIS, ", i AS (SELECT source_file, count(*) AS records FROM equipment WHERE trim(concat(equipment_type, model, quantity, serial_number, inventory_number)) <> '' GROUP BY 1)\n"
    "SELECT a.source_file, count(*) AS pages, count(*) FILTER (page_type = 'digital') AS native_pages, count(*) FILTER (page_type = 'mixed') AS hybrid_pages, count(*) FILTER (page_type = 'scanned') AS ocr_pages, coalesce(max(records), 0) AS records FROM analysis a LEFT JOIN i USING (source_file) GROUP BY 1"),
)
def g10(spark, base):
    pages = routing.route(layout.page_analysis(words(spark, base)), "automatic", F.lit(False))
    items = table(spark, base, "equipment").where(forms.populated()).groupBy("source_file").agg(F.count(F.lit(1)).alias("records"))
    by_file = pages.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("pages"), *(F.count_if(F.col("extraction_source") == s).alias(f"{s}_pages") for s in ("native", "hybrid", "ocr"))
    )
    return by_file.join(items, "source_file", "left").fillna(0, ["records"])


@query(
    "x01_page_routes",
    with_(ANALYSIS, ", m AS (SELECT unnest(['automatic', 'always', 'never']) AS ocr_mode)\n"
    "SELECT ocr_mode, page_type, CASE WHEN ocr_mode = 'always' OR page_type = 'scanned' THEN 'ocr' WHEN page_type = 'mixed' AND ocr_mode <> 'never' THEN 'hybrid' ELSE 'native' END AS extraction_source,"
    " page_type = 'mixed' AND ocr_mode = 'automatic' AS merge_ocr, ocr_mode = 'always' OR page_type = 'scanned' AS use_ocr, count(*) AS n FROM analysis, m GROUP BY ALL"),
)
def x01(spark, base):
    modes = F.explode(F.array(*(F.lit(m) for m in routing.OCR_MODES)))
    pages = layout.page_analysis(words(spark, base)).withColumn("ocr_mode", modes)
    return routing.route(pages, F.col("ocr_mode"), F.lit(False)).groupBy("ocr_mode", "page_type", "extraction_source", "merge_ocr", "use_ocr").agg(F.count(F.lit(1)).alias("n"))


def whole_run(spark, base) -> routing.Run:
    return routing.convert(words(spark, base), lines(spark, base))


@query("x02_form_records")
def x02(spark, base):
    return whole_run(spark, base).forms()


@query("x02_run_counters")
def x02_counters(spark, base):
    return whole_run(spark, base).counters()


@query("x02_run_warnings")
def x02_warnings(spark, base):
    return whole_run(spark, base).warnings


# Sorts, limits, sets -------------------------------------------------------------------------


@query("o01_lines_in_order", with_(LINES, "SELECT source_file, page_number, line_id, row_number() OVER (PARTITION BY source_file, page_number ORDER BY start_y, start_x, line_id) AS place FROM lines"))
def o01(spark, base):
    w = Window.partitionBy(*KEYS).orderBy("start_y", "start_x", "line_id")
    return lines(spark, base).select(*KEYS, "line_id", F.row_number().over(w).cast("bigint").alias("place"))


@query("o02_widest_word", "SELECT source_file, page_number, word_id FROM words WHERE x1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_file, page_number ORDER BY x1 - x0 DESC, word_id DESC) = 1")
def o02(spark, base):
    best = F.max(F.struct((F.col("x1") - F.col("x0")).alias("w"), "word_id"))
    return words(spark, base).where("x1 IS NOT NULL").groupBy(*KEYS).agg(best["word_id"].alias("word_id"))


@query("o03_pages_without_forms", "SELECT DISTINCT source_file, page_number FROM words EXCEPT SELECT source_file, page_number FROM forms")
def o03(spark, base):
    return words(spark, base).select(*KEYS).distinct().join(table(spark, base, "forms").select(*KEYS).distinct(), KEYS, "left_anti")


@query(
    "o04_all_warnings",
    "SELECT source_file, page_number, code, message FROM conversion_warnings UNION ALL SELECT source_file, page_number, 'INVALID_DATE', 'Form without handover date' FROM forms WHERE handover_date IS NULL",
)
def o04(spark, base):
    own = table(spark, base, "forms").where("handover_date IS NULL").select(*KEYS, F.lit("INVALID_DATE").alias("code"), F.lit("Form without handover date").alias("message"))
    return table(spark, base, "conversion_warnings").select(*KEYS, "code", "message").unionByName(own)


@query(
    "o05_items_or_words",
    "WITH i AS (SELECT source_file, page_number, count(*) AS n FROM equipment GROUP BY 1, 2), w AS (SELECT source_file, page_number, count(*) AS n FROM words GROUP BY 1, 2) "
    "SELECT source_file, page_number, n, 'items' AS origin FROM i UNION ALL SELECT source_file, page_number, n, 'words' FROM w WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.source_file = w.source_file AND i.page_number = w.page_number)",
)
def o05(spark, base):
    count = lambda name, origin: table(spark, base, name).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit(origin))
    return routing.first_available(count("equipment", "items"), count("words", "words"), KEYS)


# Scalars -------------------------------------------------------------------------------------

BL = STRIPPED


@query("t01_normalized_text", rf"SELECT form_id, regexp_replace(regexp_replace(nfc_normalize(replace(person_name, chr(0), '')), '[ \t]+', ' ', 'g'), '^{BL}+|{BL}+$', '', 'g') AS person_name FROM forms")
def t01(spark, base):
    return table(spark, base, "forms").select("form_id", T.normalize_text(F.col("person_name")).alias("person_name"))


@query("t02_form_text")
def t02(spark, base):
    return words(spark, base).select("word_id", T.normalize_form_text(F.col("text")).alias("text"))


INFER = rf"""
v AS (SELECT warning_id AS id, field_value AS raw, regexp_replace(field_value, '^{BL}+|{BL}+$', '', 'g') AS v FROM conversion_warnings
      UNION ALL SELECT item_id + 1000000000, quantity, regexp_replace(quantity, '^{BL}+|{BL}+$', '', 'g') FROM equipment),
k AS (
  SELECT *, v = '' OR (length(v) > 1 AND v LIKE '0%') AS keep,
         coalesce(try_strptime(CASE WHEN regexp_full_match(v, '[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}}') THEN v END, '%d.%m.%Y'),
                  try_strptime(CASE WHEN regexp_full_match(v, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN v END, '%d/%m/%Y'),
                  try_strptime(CASE WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN v END, '%Y-%m-%d')) AS stamp
  FROM v),
kinds AS (
  SELECT *, CASE WHEN raw IS NULL THEN NULL WHEN NOT keep AND regexp_full_match(v, '[-+]?[0-9]{{1,18}}') THEN 'int'
                 WHEN NOT keep AND regexp_full_match(v, '[-+]?[0-9]+[.,][0-9]+') THEN 'float' WHEN NOT keep AND stamp IS NOT NULL THEN 'date' ELSE 'text' END AS kind FROM k)"""


def typed_values(spark, base) -> DataFrame:
    a = table(spark, base, "conversion_warnings").select(F.col("warning_id").alias("id"), F.col("field_value").alias("raw"))
    b = table(spark, base, "equipment").select((F.col("item_id") + 1000000000).alias("id"), F.col("quantity").alias("raw"))
    return a.unionByName(b)


@query(
    "t03_inferred_values",
    with_(INFER, "SELECT id, kind, CASE WHEN kind = 'int' THEN CAST(v AS BIGINT) END AS i, CASE WHEN kind = 'float' THEN CAST(replace(v, ',', '.') AS DOUBLE) END AS d, CASE WHEN kind = 'date' THEN stamp END AS t, CASE WHEN kind = 'text' THEN v END AS s FROM kinds"),
)
def t03(spark, base):
    return typed_values(spark, base).select("id", T.inferred(F.col("raw")).alias("v")).select("id", "v.*")


@query("t04_formula_safe", rf"SELECT item_id, CASE WHEN regexp_matches(serial_number, '^{BL}*[=+\-@]') THEN '''' || serial_number ELSE serial_number END AS serial_number, CASE WHEN regexp_matches(quantity, '^{BL}*[=+\-@]') THEN '''' || quantity ELSE quantity END AS quantity FROM equipment")
def t04(spark, base):
    return table(spark, base, "equipment").select("item_id", *(T.formula_safe(F.col(c)).alias(c) for c in ("serial_number", "quantity")))


@query(
    "t05_parsed_dates",
    r"""WITH t AS (SELECT form_id, 'Datum predaje: ' || strftime(handover_date, '%d / %m / %Y') || '.' AS s FROM forms UNION ALL SELECT warning_id + 1000000000, field_value FROM conversion_warnings),
p AS (SELECT *, regexp_extract(s, '(?:^|[^0-9])([0-9]{1,2})\s*[./|\- ]\s*([0-9]{1,2})\s*[./|\- ]\s*([0-9]{4})(?:[^0-9]|$)', ['d', 'm', 'y']) AS x FROM t)
SELECT form_id AS id, CAST(try_strptime(x.y || '-' || lpad(x.m, 2, '0') || '-' || lpad(x.d, 2, '0'), '%Y-%m-%d') AS DATE) AS day FROM p""",
)
def t05(spark, base):
    a = table(spark, base, "forms").select(F.col("form_id").alias("id"), F.concat(F.lit("Datum predaje: "), F.date_format("handover_date", "dd / MM / yyyy"), F.lit(".")).alias("s"))
    b = table(spark, base, "conversion_warnings").select((F.col("warning_id") + 1000000000).alias("id"), F.col("field_value").alias("s"))
    return a.unionByName(b).select("id", T.day_month_year(F.col("s")).alias("day"))


@query("t06_value_after_label", rf"SELECT form_id, regexp_replace(regexp_extract('Opremu   primio :_ ' || received_by, '(?is)^.*?(?:opremu\s+primio)\s*[:：]?\s*(.*)$', 1), '^[ _|:：]+|[ _|:：]+$', '', 'g') AS received_by FROM forms")
def t06(spark, base):
    return table(spark, base, "forms").select("form_id", T.value_after(F.concat(F.lit("Opremu   primio :_ "), F.col("received_by")), r"opremu\s+primio").alias("received_by"))


@query("t07_similarity")
def t07(spark, base):
    return table(spark, base, "forms").select("form_id", T.similarity(F.col("person_name"), F.col("received_by")).alias("similarity"))


@query(
    "t08_joined_words",
    rf"WITH w AS (SELECT source_file, page_number, x0, word_id, regexp_replace(text, '^{BL}+|{BL}+$', '', 'g') AS t FROM words) SELECT source_file, page_number, string_agg(t, ' ' ORDER BY x0, word_id) AS text FROM w WHERE t <> '' GROUP BY 1, 2",
)
def t08(spark, base):
    one = words(spark, base).withColumn("line_no", F.lit(0))
    return cluster.line_text(one, KEYS).select(*KEYS, "text")


@query(
    "t10_export_values",
    with_(INFER, rf"SELECT id, kind, CASE WHEN kind = 'text' THEN CASE WHEN regexp_matches(v, '^{BL}*[=+\-@]') THEN '''' || v ELSE v END END AS s FROM kinds"),
)
def t10(spark, base):
    return typed_values(spark, base).select("id", T.export_value(F.col("raw")).alias("v")).select("id", "v.kind", "v.s")


# Sinks ---------------------------------------------------------------------------------------


@query(
    "k02_equipment_sheet",
    rf"""WITH f AS (SELECT * FROM forms QUALIFY row_number() OVER (PARTITION BY source_file, page_number ORDER BY ingested_at DESC NULLS LAST, form_id DESC) = 1),
e AS (SELECT * FROM equipment WHERE regexp_matches(concat(equipment_type, model, quantity, serial_number, inventory_number), '[^\s\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]'))
SELECT source_file, page_number, """
    + ", ".join(
        f"CASE WHEN regexp_matches({t}.{c}, '^{BL}*[=+\\-@]') THEN '''' || {t}.{c} ELSE {t}.{c} END AS {c}"
        for t, cs in (("f", ("person_name", "person_identifier", "organization_unit")), ("e", forms.ITEM_FIELDS), ("f", ("handed_over_by", "received_by")))
        for c in cs
    )
    + ", f.handover_date, e.confidence FROM f JOIN e USING (source_file, page_number)",
)
def k02(spark, base):
    latest = forms.latest_by_page(table(spark, base, "forms"), [F.desc_nulls_last("ingested_at"), F.desc("form_id")])
    return xlsx.equipment_sheet(latest, table(spark, base, "equipment").where(forms.populated()))


@query("k05_column_widths", "SELECT CAST(least(60, greatest(10, max(length(serial_number)) + 2)) AS BIGINT) AS serial_number, CAST(least(60, greatest(10, max(length(model)) + 2)) AS BIGINT) AS model, CAST(least(60, greatest(10, max(length(equipment_type)) + 2)) AS BIGINT) AS equipment_type FROM equipment")
def k05(spark, base):
    return table(spark, base, "equipment").agg(
        *(F.least(F.lit(60), F.greatest(F.lit(10), F.max(F.length(c)) + 2)).cast("bigint").alias(c) for c in ("serial_number", "model", "equipment_type"))
    )


@query("k08_output_paths", r"SELECT DISTINCT source_file, regexp_replace(source_file, '^(.*?)(\.[^./\\]*)?$', '\1.xlsx') AS target FROM forms")
def k08(spark, base):
    return table(spark, base, "forms").select("source_file").distinct().withColumn("target", T.default_output(F.col("source_file")))
