"""Native words and OCR words of a page reconciled."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.layout import PAGE


def merge_words(words: DataFrame, same_place: float = 0.6, same_text: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Merged words of each page, and warnings where the two readings disagree.

    OCR words are taken in order. One that covers no word so far is added. Else it is
    compared with the most similar word it covers: if they agree it is dropped, if not
    a warning is raised and the surer of the two stays, an OCR word then moving to the
    end. OCR words also compete with OCR words taken before. A word without a whole box
    covers nothing and is kept. What a word meets depends on those before it, so a page
    is one group; it holds what fits on a page.
    """
    flat = words.select(
        *PAGE, "word_id", "text", "x0", "y0", "x1", "y1", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "source"
    )
    out = "source_file string, page_number bigint, word_id bigint, position bigint, similarity double"

    def covers(a: dict, b: dict) -> float:
        if any(r[e] is None for r in (a, b) for e in ("x0", "y0", "x1", "y1")):
            return 0.0
        w, h = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
        least = min((a["x1"] - a["x0"]) * (a["y1"] - a["y0"]), (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]))
        return w * h / least if w >= 0 and h >= 0 and least > 0 else 0.0

    def alike(a: dict, b: dict) -> float:
        return SequenceMatcher(None, (a["text"] or "").casefold(), (b["text"] or "").casefold()).ratio()

    def solve(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["word_id"])
        kept = [r for r in rows if r["source"] != "ocr"]
        doubts: list[tuple[dict, float]] = []
        for word in (r for r in rows if r["source"] == "ocr"):
            under = [(alike(k, word), -i) for i, k in enumerate(kept) if covers(k, word) >= same_place]
            if not under:
                kept.append(word)
                continue
            ratio, at = max(under)
            if ratio < same_text:
                doubts.append((word, ratio))
                if word["confidence"] > kept[-at]["confidence"]:
                    kept.pop(-at)
                    kept.append(word)
        page = [rows[0][c] for c in PAGE]
        lines = [(*page, w["word_id"], i, None) for i, w in enumerate(kept)] + [(*page, w["word_id"], None, r) for w, r in doubts]
        columns = list(zip(*lines, strict=True))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["source_file", "page_number", "word_id", "position", "similarity"])

    solved = flat.groupBy(*PAGE).applyInArrow(solve, out)
    keys = [*PAGE, "word_id"]
    merged = solved.where("position IS NOT NULL").select(*keys, "position").join(flat, keys)
    warnings = solved.where("similarity IS NOT NULL").select(*keys, "similarity").join(flat, keys).select(
        *PAGE, F.col("text").alias("field_value"), "confidence", "source", F.lit("NATIVE_OCR_DISAGREEMENT").alias("code"),
        F.lit("warning").alias("severity"), F.lit("Native/OCR disagreement").alias("message"), "similarity",
    )
    return merged, warnings


def second_reading(words: DataFrame, share: int = 3) -> DataFrame:
    """A fixture: native words read a second time, shifted by a unit, every fifth of them backwards."""
    again = words.where((F.col("word_id") % share == 0) & (F.col("source") == "native")).select(
        *PAGE, (F.col("word_id") + F.lit(10**12)).alias("word_id"),
        F.when(F.col("word_id") % 5 == 0, F.reverse("text")).otherwise(F.col("text")).alias("text"),
        *((F.col(e) + 1).alias(e) for e in ("x0", "y0", "x1", "y1")), ((F.col("word_id") % 100) / 100).alias("confidence"), F.lit("ocr").alias("source"),
    )
    return words.select(*again.columns).unionByName(again)
