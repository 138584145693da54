from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.geometry import Box, cell_rects, points_to_pixels, quarantine

EDGES = "x0 double, y0 double, x1 double, y1 double, c_x0 double, c_y0 double, c_x1 double, c_y1 double"


def one(spark, *edges):
    return spark.createDataFrame([tuple(map(float, edges))], EDGES)


def test_intersection_and_ratio(spark):
    df = one(spark, 0, 0, 10, 20, 5, 10, 15, 30)
    a, b = Box.named(), Box.named("c_")
    r = df.select(*a.meet(b).columns(), a.overlap_ratio(b).alias("r"), a.intersects(b).alias("i"), a.contains(b).alias("c")).first()
    assert tuple(r) == (5.0, 10.0, 10.0, 20.0, 0.25, True, False)


def test_touching_boxes_meet_without_overlap(spark):
    df = one(spark, 0, 0, 10, 10, 10, 0, 20, 10)
    a, b = Box.named(), Box.named("c_")
    assert tuple(df.select(a.intersects(b), a.overlap_ratio(b)).first()) == (True, 0.0)
    flat = one(spark, 0, 0, 10, 0, 0, 0, 20, 10)
    assert flat.select(a.overlap_ratio(b)).first()[0] == 0.0


def test_cells_and_scaling(spark):
    df = spark.createDataFrame([([0.0, 5.0, 9.0], [0.0, 4.0])], "r array<double>, c array<double>")
    assert [tuple(x) for x in df.select(F.inline(cell_rects(F.col("r"), F.col("c")))).collect()] == [(0, 0, 0.0, 0.0, 4.0, 5.0), (1, 0, 0.0, 5.0, 4.0, 9.0)]
    empty = spark.createDataFrame([([], [1.0])], "r array<double>, c array<double>")
    assert empty.select(F.size(cell_rects(F.col("r"), F.col("c")))).first()[0] == 0
    p = points_to_pixels(Box.named(), F.lit(100.0), F.lit(200.0), F.lit(200), F.lit(200))
    assert tuple(one(spark, 1, 2, 3, 4, 0, 0, 0, 0).select(*p.columns()).first()) == (2.0, 2.0, 6.0, 4.0)


def test_quarantine(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (2.0, 0.0, 1.0, 1.0), (None, 0.0, 1.0, 1.0)], "x0 double, y0 double, x1 double, y1 double")
    good, bad = quarantine(df)
    assert (good.count(), bad.count()) == (1, 2)
