"""Queries over drawn pages hold one picture at a time."""

from __future__ import annotations

import os
import re
from pathlib import Path

import numpy as np
import pytest

from gridloom.functions import imaging
from gridloom.plans import reference

PAGES, HEIGHT = 1000, 1000


@pytest.fixture(scope="module")
def tall(spark, tmp_path_factory):
    """Pages of 300 kB when drawn: a level rule above a letter, both far apart."""
    base = str(tmp_path_factory.mktemp("tall"))
    sides = [("'-'", 10, 20, 250, 22), ("'x'", 280, HEIGHT - 20, 290, HEIGHT - 10), ("'7'", 20, 60, 26, 72)]
    rows = ", ".join(f"struct(id * 3 + {k} AS word_id, {t} AS text, {x0}D AS x0, {y0}D AS y0, {x1}D AS x1, {y1}D AS y1)" for k, (t, x0, y0, x1, y1) in enumerate(sides))
    pages = spark.range(PAGES).selectExpr("'a' AS source_file", "id + 1 AS page_number", f"explode(array({rows})) AS w")
    pages.select("source_file", "page_number", "w.*").write.parquet(f"{base}/words.parquet")
    return base


def workers() -> list[Path]:
    """Python workers below this process."""
    above = {}
    for p in Path("/proc").glob("[0-9]*"):
        try:
            above[p.name] = (p / "stat").read_text().rpartition(")")[2].split()[1]
        except OSError:
            pass

    def ours(pid: str) -> bool:
        while pid in above and pid != str(os.getpid()):
            pid = above[pid]
        return pid == str(os.getpid())

    found = []
    for pid in above:
        try:
            if ours(pid) and b"pyspark.daemon" in Path(f"/proc/{pid}/cmdline").read_bytes():
                found.append(Path("/proc", pid))
        except OSError:
            pass
    return found


def peak_mb(run):
    """What ``run`` returns, and the memory of the largest Python worker meanwhile."""
    for p in workers():
        try:
            (p / "clear_refs").write_text("5")
        except OSError:
            pass
    result, most = run(), 0
    for p in workers():
        try:
            most = max(most, *(int(kb) // 1024 for kb in re.findall(r"VmHWM:\s+(\d+)", (p / "status").read_text())))
        except OSError:
            pass
    assert most, "no worker was seen"
    return result, most


def test_metrics_of_many_large_pages(spark, tall):
    rows, mb = peak_mb(lambda: reference.QUERIES["g11_render_metrics"](spark, tall).collect())
    assert {r["page_number"] for r in rows} == set(range(1, PAGES + 1)) and {(r["components"], r["minimum"], r["maximum"]) for r in rows} == {(3, 40.0, 255.0)}
    assert mb < 400


def test_components_are_those_of_a_flood_fill():
    rng = np.random.default_rng(3)
    for share in (0.1, 0.4, 0.6, 0.9):
        mask = rng.random((23, 31)) < share
        left, boxes = {*zip(*(x.tolist() for x in np.nonzero(mask)), strict=True)}, []
        for y, x in sorted(left):
            if (y, x) not in left:
                continue
            left.remove((y, x))
            seen = [(y, x)]
            for a, b in seen:
                near = left & {(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)}
                left -= near
                seen += near
            ys, xs = zip(*seen, strict=True)
            boxes.append([min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(seen)])
        assert imaging.mask_boxes(mask).tolist() == boxes
        assert imaging.component_boxes(*imaging.label_components(mask)).tolist() == boxes
    assert imaging.mask_boxes(np.zeros((4, 5), bool)).shape == (0, 5)


def test_ink_on_many_large_pages(spark, tall):
    rows, mb = peak_mb(lambda: reference.QUERIES["j08_words_with_ink"](spark, tall).collect())
    assert {(r["page_number"], r["word_id"], r["has_ink"]) for r in rows} == {(p + 1, 3 * p + k, k == 1) for p in range(PAGES) for k in (0, 1)}
    assert mb < 400


def test_rules_of_many_large_pages(spark, tall):
    rows, mb = peak_mb(lambda: reference.QUERIES["i07_raster_rules"](spark, tall).collect())
    level = [(r["page_number"], r["start_x"], r["end_x"], r["thickness"]) for r in rows if r["is_horizontal"] and r["end_x"] - r["start_x"] > 100]
    assert sorted(level) == [(p, 10.0, 250.0, 2.0) for p in range(1, PAGES + 1)]
    assert mb < 400


def test_threshold_is_that_of_the_gaussian_mean():
    rng = np.random.default_rng(4)
    flat = np.full((40, 50), 90, np.uint8)
    for image in (rng.integers(0, 256, (70, 131), dtype=np.uint8), rng.integers(100, 104, (5, 300), dtype=np.uint8), flat, flat[:1, :1]):
        for block, offset in ((31, 13.0), (35, 15.0), (31, 0.0)):
            assert ((imaging.binarize(image, block, offset) > 0) == (image > imaging.gaussian_blur(image, block) - offset)).all()
