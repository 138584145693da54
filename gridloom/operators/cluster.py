"""Grouping along an axis: clusters, lines of text, rows, merged rules.

With a constant tolerance, first-fit grouping by the first member equals comparing
with the last group's first member, which is a fold over a sorted array and stays
in the JVM. Groupings whose tolerance depends on the members, or whose groups move
as they grow, have no such form and run as grouped Arrow functions, a page at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.layout import PAGE


def axis_clusters(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Single linkage along one axis: ``keys, cluster, position, n``.

    A new cluster begins where the gap to the previous value exceeds the tolerance;
    its position is the mean of its values.
    """
    w = Window.partitionBy(*keys).orderBy("_v")
    # Equal values are one step, so ties cannot fall on both sides of a gap.
    values = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    step = values.withColumn("_gap", F.col("_v") - F.lag("_v").over(w))
    islands = step.withColumn("cluster", F.sum(F.when(F.col("_gap") > tolerance, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, F.col("cluster").cast("bigint").alias("cluster")).agg(
        (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("position"), F.sum("_n").alias("n")
    )


def anchors_of(sorted_values: Column, tolerance: Column) -> Column:
    """First members of the groups that a first-fit scan with a constant tolerance makes."""
    none = F.array().cast("array<double>")
    return F.aggregate(
        sorted_values,
        none,
        lambda acc, v: F.when((F.size(acc) == 0) | (v - F.try_element_at(acc, F.lit(-1)) > tolerance), F.concat(acc, F.array(v))).otherwise(acc),
    )


def text_lines(words: DataFrame, keys: list[str], tolerance: Column | float, along: str = "center_y") -> DataFrame:
    """Words with ``line_no`` from 0 and ``place`` from 0 in their line.

    ``along`` is ``center_y`` (reading order: words of a line by ``x0``) or ``top``
    (words keep their order by top and ``x0``). Equal places are broken by ``word_id``.
    A page, or a cell of it, is one group; it holds what fits on a page.
    """
    at = (F.col("y0") + F.col("y1")) / 2 if along == "center_y" else F.col("y0")
    tol = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    item = F.struct(at.alias("at"), "x0", "word_id", "text", "y1", "y0", "x1", "confidence")
    placed = words.where(at.isNotNull() & F.col("x0").isNotNull())
    grouped = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_words"), F.first(tol).alias("_tol"))
    grouped = grouped.withColumn("_anchors", anchors_of(F.transform("_words", lambda w: w["at"]), F.col("_tol")))
    line = lambda w: F.size(F.filter("_anchors", lambda a: a <= w["at"])) - 1
    if along == "center_y":
        key = lambda w: F.struct(line(w).alias("line_no"), w["x0"].alias("a"), w["at"].alias("b"), w["word_id"].alias("word_id"), w["text"].alias("text"), w["confidence"].alias("confidence"))
    else:
        key = lambda w: F.struct(line(w).alias("line_no"), w["at"].alias("a"), w["x0"].alias("b"), w["word_id"].alias("word_id"), w["text"].alias("text"), w["confidence"].alias("confidence"))
    ordered = grouped.select(*keys, F.posexplode(F.array_sort(F.transform("_words", key))).alias("_p", "_w"))
    w = Window.partitionBy(*keys, "_w.line_no").orderBy("_p")
    return ordered.select(
        *keys, F.col("_w.word_id").alias("word_id"), F.col("_w.text").alias("text"), F.col("_w.line_no").cast("bigint").alias("line_no"),
        (F.row_number().over(w) - 1).cast("bigint").alias("place"), F.col("_w.confidence").alias("confidence"),
    )


def page_tolerance(words: DataFrame) -> DataFrame:
    """By page: 0.55 of the exact median height of words with a height, at least 1; 2 where there are none."""
    height = F.col("y1") - F.col("y0")
    return words.groupBy(*PAGE).agg(F.coalesce(F.greatest(F.lit(1.0), F.median(F.when(height > 0, height)) * 0.55), F.lit(2.0)).alias("tolerance"))


def joined_lines(lines: Column) -> Column:
    """Lines of text as one: directly after a hyphen, else with a blank; empty lines vanish."""
    return F.aggregate(
        lines,
        F.lit(""),
        lambda acc, t: F.when(acc.endswith("-"), F.concat(acc, t)).when(acc == "", t).when(t == "", acc).otherwise(F.concat(acc, F.lit(" "), t)),
    )


def _per_page(df: DataFrame, keys: list[str], run: Callable[[list[dict]], list[dict]], out: str) -> DataFrame:
    names = [p.strip().split(" ")[0] for p in out.split(",")]

    def solve(table: pa.Table) -> pa.Table:
        rows = run(table.to_pylist())
        return pa.table({n: [r.get(n) for r in rows] for n in names}) if rows else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(out))
    empty = schema.empty_table()

    def typed(table: pa.Table) -> pa.Table:
        return solve(table).cast(schema)

    return df.groupBy(*keys).applyInArrow(typed, out)


def legacy_rows(words: DataFrame) -> DataFrame:
    """Rows of words with a tolerance of its own for each word: ``row_no`` and ``col_no`` from 0.

    A word joins the first row, of all there are, whose first word lies within
    max(5, 0.6 of the word's height); rows stay in the order of their first words.
    """

    def run(rows: list[dict]) -> list[dict]:
        heads: list[float] = []
        groups: list[list[dict]] = []
        for w in sorted(rows, key=lambda r: ((r["y0"] + r["y1"]) / 2, r["x0"], r["word_id"])):
            at, reach = (w["y0"] + w["y1"]) / 2, max(5.0, 0.6 * (w["y1"] - w["y0"]))
            k = next((k for k, head in enumerate(heads) if abs(head - at) <= reach), None)
            if k is None:
                heads.append(at)
                groups.append([w])
            else:
                groups[k].append(w)
        out = []
        for row_no, group in enumerate(groups):
            for col_no, w in enumerate(sorted(group, key=lambda r: (r["x0"], r["word_id"]))):
                out.append({k: w[k] for k in (*PAGE, "word_id", "text")} | {"row_no": row_no, "col_no": col_no})
        return out

    cols = words.where("y0 IS NOT NULL AND y1 IS NOT NULL AND x0 IS NOT NULL").select(*PAGE, "word_id", "text", "x0", "y0", "y1")
    return _per_page(cols, list(PAGE), run, "source_file string, page_number bigint, word_id bigint, text string, row_no bigint, col_no bigint")


def legacy_cell_text(rows: DataFrame, keys: list[str], line_breaks: bool = False) -> DataFrame:
    """Text of groups of :func:`legacy_rows`: words stripped, empty ones dropped, rows joined."""
    word = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    lines = (
        rows.withColumn("_t", word)
        .where("_t <> ''")
        .groupBy(*keys, "row_no")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "word_id", "_t"))), lambda x: x["_t"]), " ").alias("_line"))
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "_line"))), lambda x: x["_line"]).alias("_lines"))
    )
    return lines.select(*keys, (F.array_join("_lines", "\n") if line_breaks else joined_lines(F.col("_lines"))).alias("text"))


def merge_collinear(lines: DataFrame, tolerance: float = 3.0, gap: float = 12.0) -> DataFrame:
    """Fragments of one rule merged: within a tolerance across it and a gap along it.

    Lines are taken by (start_y, start_x, line_id). One joins the first kept line of its
    direction that it continues; that line then spans both, at the mean of the two axes,
    so it may drift. Directions never mix, so they are groups of their own.
    """

    def run(rows: list[dict]) -> list[dict]:
        flat = bool(rows[0]["is_horizontal"])
        axis, lo, hi = ("y", "start_x", "end_x") if flat else ("x", "start_y", "end_y")
        kept: list[dict] = []
        for r in sorted(rows, key=lambda r: (r["start_y"], r["start_x"], r["line_id"])):
            a, b = sorted((r[lo], r[hi]))
            here = (r[f"start_{axis}"] + r[f"end_{axis}"]) / 2
            for k in kept:
                if abs(k["at"] - here) <= tolerance and a <= k["b"] + gap and b >= k["a"] - gap:
                    k.update(a=min(k["a"], a), b=max(k["b"], b), at=(k["at"] + here) / 2, thickness=max(k["thickness"], r["thickness"]))
                    break
            else:
                kept.append({"a": a, "b": b, "at": here, "thickness": r["thickness"]})
        out = []
        for n, k in enumerate(kept):
            ends = (k["a"], k["at"], k["b"], k["at"]) if flat else (k["at"], k["a"], k["at"], k["b"])
            out.append(
                {c: rows[0][c] for c in (*PAGE, "is_horizontal")} | dict(zip(("start_x", "start_y", "end_x", "end_y"), ends, strict=True))
                | {"line_id": n, "thickness": k["thickness"]}
            )
        return out

    cols = [*PAGE, "is_horizontal", "line_id", "start_x", "start_y", "end_x", "end_y", "thickness"]
    ready = lines.select(*cols).where("start_x IS NOT NULL AND start_y IS NOT NULL AND end_x IS NOT NULL AND end_y IS NOT NULL")
    out = "source_file string, page_number bigint, is_horizontal boolean, line_id bigint, start_x double, start_y double, end_x double, end_y double, thickness double"
    return _per_page(ready, [*PAGE, "is_horizontal"], run, out)


def footer_lines(words: DataFrame) -> DataFrame:
    """Lines of text below a table: ``line_no`` from 0.

    A word joins the latest line whose first word lies within 0.65 of the greater height.
    """

    def run(rows: list[dict]) -> list[dict]:
        heads: list[tuple[float, float]] = []
        out = []
        for w in sorted(rows, key=lambda r: ((r["y0"] + r["y1"]) / 2, r["x0"], r["word_id"])):
            at, height = (w["y0"] + w["y1"]) / 2, w["y1"] - w["y0"]
            k = next((k for k in range(len(heads) - 1, -1, -1) if abs(heads[k][0] - at) <= 0.65 * max(heads[k][1], height)), None)
            if k is None:
                k = len(heads)
                heads.append((at, height))
            out.append({c: w[c] for c in (*PAGE, "word_id", "text", "x0")} | {"line_no": k})
        return out

    cols = words.where("y0 IS NOT NULL AND y1 IS NOT NULL AND x0 IS NOT NULL").select(*PAGE, "word_id", "text", "x0", "y0", "y1")
    return _per_page(cols, list(PAGE), run, "source_file string, page_number bigint, word_id bigint, text string, x0 double, line_no bigint")


def line_text(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Stripped, non-blank words of each line joined from left to right."""
    word = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_id", "_t"))), lambda x: x["_t"]), " ")
    return lines.withColumn("_t", word).where("_t <> ''").groupBy(*keys, "line_no").agg(joined.alias("text"))
