"""Form records: template match, equipment rows, header and footer fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.functions.geometry import Box
from gridloom.operators import cluster
from gridloom.sources.layout import PAGE

KEYS = list(PAGE)
#: The columns of an equipment list and the parts of its header.
ITEM_FIELDS = ("item_number", "equipment_type", "model", "quantity", "serial_number", "inventory_number")
HEADER_PARTS = ("red", "oprem", "model", "kol", "serij", "inventar")


@dataclass(frozen=True)
class Template:
    """A kind of form: the phrases that mark it and what they weigh."""

    name: str
    anchors: tuple[str, ...]
    title: str
    title_bonus: float
    table_anchors: tuple[str, ...]
    table_hits: int
    table_bonus: float


#: The phrases of an equipment handover form.
REVERS = Template(
    "REVERS",
    (
        "revers", "dole navedena oprema", "red. broj", "vrsta računarske opreme", "model", "kol", "serijski broj",
        "inventarski broj", "zaključno sa rednim brojem", "datum predaje opreme", "opremu predao", "opremu primio",
    ),
    "revers", 0.12,
    ("red. broj", "vrsta računarske opreme", "model", "kol", "serijski broj", "inventarski broj"), 4, 0.18,
)
TEMPLATES: dict[str, Template] = {REVERS.name: REVERS}


def register_template(template: Template) -> None:
    """Makes a further kind of form known to :func:`match_templates`."""
    TEMPLATES[template.name] = template


def page_text(words: DataFrame) -> DataFrame:
    """Words of each page in the order of their identifiers, joined with blanks."""
    ordered = F.array_sort(F.collect_list(F.struct("word_id", F.coalesce("text", F.lit("")).alias("t"))))
    return words.groupBy(*KEYS).agg(F.array_join(F.transform(ordered, lambda w: w["t"]), " ").alias("text"))


def match_templates(pages: DataFrame, threshold: float = 0.55, normalise=T.normalize_form_text) -> DataFrame:
    """Every page (``text``) against every known template: ``template, matched_anchors, confidence, accepted``."""
    ready = pages.withColumn("_n", normalise(F.col("text")))
    parts = []
    for t in TEMPLATES.values():
        hits = F.filter(F.array(*(F.lit(a) for a in t.anchors)), lambda a: F.contains(F.col("_n"), a))
        table = F.size(F.array_intersect("matched_anchors", F.array(*(F.lit(a) for a in t.table_anchors))))
        score = F.size("matched_anchors") / len(t.anchors)
        score = score + F.when(F.array_contains("matched_anchors", t.title), t.title_bonus).otherwise(0.0)
        score = score + F.when(table >= t.table_hits, t.table_bonus).otherwise(0.0)
        one = ready.withColumn("matched_anchors", hits).withColumn("confidence", F.least(F.lit(1.0), score))
        parts.append(one.select(*KEYS, F.lit(t.name).alias("template"), "matched_anchors", "confidence", (F.col("confidence") >= threshold).alias("accepted")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def equipment_rows(cells: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Rows below the header as items: six fields by column, what OCR made of rules blanked.

    The confidence of an item is the least of its cells, 1 where none is known. Items
    of which nothing but the number is filled are left out unless ``keep_empty``.
    """
    value = T.strip(F.col("text"))
    clean = cells.where("row > 0").withColumn("_v", F.when(T.is_rule_artifact(value, F.col("confidence")), "").otherwise(value))
    rows = clean.groupBy(*KEYS, "grid_id", "row").agg(
        *(F.coalesce(F.max(F.when(F.col("col") == i, F.col("_v"))), F.lit("")).alias(f) for i, f in enumerate(ITEM_FIELDS)),
        F.coalesce(F.min("confidence"), F.lit(1.0)).alias("confidence"),
    )
    return rows if keep_empty else rows.where(populated())


def populated():
    """Whether any field but the item number is filled."""
    return F.concat(*(F.coalesce(F.col(f), F.lit("")) for f in ITEM_FIELDS[1:])).rlike(r"(?U)\S")


def header_warnings(cells: DataFrame) -> DataFrame:
    """Grids whose first row shows fewer than three of the expected captions."""
    head = cells.where("row = 0").groupBy(*KEYS, "grid_id").agg(
        F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), " ")).alias("_h")
    )
    seen = F.size(F.filter(F.array(*(F.lit(p) for p in HEADER_PARTS)), lambda p: F.contains(F.col("_h"), p)))
    return head.where(seen < 3).select(*KEYS, "grid_id", F.lit("Header partially detected").alias("message"))


def header_fields(words: DataFrame, grids: DataFrame) -> DataFrame:
    """Name, identifier and unit, read from the words above their captions.

    The band reaches from the grid up to 0.18 of its height or 0.08 of the page, the
    larger. Captions are words with parts of known ones; values stand above their mean
    height, in regions at 0.48 and 0.68 of the grid's width.
    """
    g = grids.select(*KEYS, *(F.col(e).alias(f"g_{e}") for e in ("x0", "y0", "x1", "y1")))
    bottom = words.groupBy(*KEYS).agg(F.max("y1").alias("_bottom"))
    box = Box.named()
    band = F.greatest((F.col("g_y1") - F.col("g_y0")) * 0.18, F.col("_bottom") * 0.08)
    near = (
        words.join(g, KEYS).join(bottom, KEYS)
        .withColumn("_cx", box.center_x).withColumn("_cy", box.center_y)
        .where((F.col("_cy") >= F.col("g_y0") - band) & (F.col("_cy") < F.col("g_y0")))
        .withColumn("_label", T.is_label(F.col("text")))
    )
    level = near.where("_label").groupBy(*KEYS).agg(F.avg("_cy").alias("_level"))
    values = near.where("NOT _label").join(level, KEYS).where(F.col("_cy") < F.col("_level") - F.greatest(F.lit(1.0), box.height * 0.15))
    place = (F.col("_cx") - F.col("g_x0")) / F.nullif(F.col("g_x1") - F.col("g_x0"), F.lit(0.0))
    region = F.when(place < 0.48, "person").when(place < 0.68, "identifier").otherwise("unit")
    word = T.strip(F.col("text"))
    joined = lambda r: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when((F.col("_region") == r) & (word != ""), F.struct("x0", "word_id", word.alias("t"))))), lambda x: x["t"]), " "
    )
    out = values.withColumn("_region", region).groupBy(*KEYS).agg(
        joined("person").alias("person_name"), joined("identifier").alias("_id"), joined("unit").alias("organization_unit")
    )
    return out.select(*KEYS, "person_name", F.regexp_replace("_id", r"[^0-9]", "").alias("person_identifier"), "organization_unit")


def footer_fields(words: DataFrame, grids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Closing number, date, issuer and receiver from the lines below the grid, and warnings on dates.

    A line gives the first field whose caption it has; of several lines the last counts.
    """
    g = grids.select(*KEYS, F.col("y1").alias("g_y1"))
    below = words.join(g, KEYS).where(Box.named().center_y > F.col("g_y1")).drop("g_y1")
    lines = cluster.line_text(cluster.footer_lines(below), KEYS).withColumn("_low", F.lower("text"))
    has = lambda p: F.contains(F.col("_low"), F.lit(p))
    kind = (
        F.when(has("zaklju") & has("broj"), "closing")
        .when(has("datum") & (has("predaj") | has("oprem")), "date")
        .when(has("opremu predao"), "from")
        .when(has("opremu primio"), "to")
    )
    text = F.col("text")
    raw = (
        F.when(F.col("_kind") == "closing", T.value_after(text, "broj(?:em)?"))
        .when(F.col("_kind") == "date", T.value_after(text, "opreme"))
        .when(F.col("_kind") == "from", T.value_after(text, r"opremu\s+predao"))
        .when(F.col("_kind") == "to", T.value_after(text, r"opremu\s+primio"))
    )
    found = lines.withColumn("_kind", kind).where("_kind IS NOT NULL").withColumn("_raw", raw).withColumn("_day", T.day_month_year(F.col("_raw")))
    last = lambda k, v="_raw", also=F.lit(True): F.max_by(v, F.when((F.col("_kind") == k) & also, F.col("line_no")))
    fields = found.groupBy(*KEYS).agg(
        F.coalesce(last("closing"), F.lit("")).alias("closing_item_number"),
        last("date", "_day", F.col("_day").isNotNull()).alias("handover_date"),
        F.coalesce(last("from"), F.lit("")).alias("handed_over_by"),
        F.coalesce(last("to"), F.lit("")).alias("received_by"),
    )
    doubtful = found.where("_kind = 'date' AND _day IS NULL").where(F.col("_raw").rlike("[0-9]")).select(
        *KEYS, F.lit("Invalid or uncertain handover date").alias("message"), F.lit("handover_date").alias("field_name"), F.col("_raw").alias("field_value")
    )
    return fields, doubtful


def form_records(words: DataFrame, grids: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per form with its header, footer and items."""
    items = equipment_rows(cells).groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("row", *ITEM_FIELDS, "confidence"))).alias("items"), F.min("confidence").alias("confidence")
    )
    fields, _ = footer_fields(words, grids)
    pages = grids.select(*KEYS).distinct()
    return pages.join(header_fields(words, grids), KEYS, "left").join(fields, KEYS, "left").join(items, KEYS, "left")


def latest_by_page(df: DataFrame, order: list) -> DataFrame:
    """One row per page, the last in the given order."""
    w = Window.partitionBy(*KEYS).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
