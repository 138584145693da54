from __future__ import annotations

import random

from gridloom.llm.copies import collapse_copies, p5_found

SCHEMA = "item_id bigint, equipment_type string, model string, quantity string, serial_number string, inventory_number string, _key string, _n int"
PLAIN, LOOSE = ("equipment_type", "model", "quantity"), ("serial_number", "inventory_number")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def test_copies(spark):
    df = frame(
        spark,
        [
            (5, "Monitor", "A-1", None, "SN 1", "I.2"), (3, "MONITOR ", "a1", "", "i2", "sn1"), (9, "Monitor", "A-1", "", "SN 1", "I.3"),
            (7, "x", "y", "1", None, " - "), (8, "x", "y", "1", "", ""), (2, "Monitor", "A-1", None, "SN 1", "I.2"), (6, None, None, None, "ž", None),
        ],
    )
    assert sorted(map(tuple, p5_found(df).collect())) == [(2, 3)]
    assert p5_found(df.limit(0)).count() == 0
    every = {r["representative"]: r["n_copies"] for r in collapse_copies(df, "item_id", PLAIN, LOOSE).collect()}
    assert every == {2: 3, 9: 1, 6: 1}


def test_hot_and_cold_paths_agree(spark):
    random.seed(4)
    rows = [(i, "t", "m", "1", "hot" if random.random() < 0.4 else f"s{random.randrange(40)}", f"{'x' * (i % 3)}-") for i in range(900)]
    df = frame(spark, [(a, b, c, d, e, None if f.startswith("-") else f) for a, b, c, d, e, f in rows]).repartition(7)
    hot = collapse_copies(df, "item_id", PLAIN, LOOSE, hot_share=0.02, salts=5)
    cold = collapse_copies(df, "item_id", PLAIN, LOOSE, hot_share=1.0)
    assert sorted(map(tuple, hot.collect())) == sorted(map(tuple, cold.collect()))
    assert hot.agg({"n_copies": "sum"}).first()[0] == 900


def test_long_text(spark):
    long = "a " * 100_000
    assert [tuple(r) for r in p5_found(frame(spark, [(1, long, "", "", "s", ""), (2, long.upper(), "", "", "S", "")])).collect()] == [(1, 2)]
