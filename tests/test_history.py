from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from gridloom.operators.history import attribute_history, p2_found, register_history

SCHEMA = "snap_row_id bigint, snapshot_date date, inventory_number string, received_by string, handover_date date, loaded_at timestamp_ntz, holder string, _entity int"


def snap(k, month, number, who, handover=None, loaded=1):
    return (k, date(2024, month, 28), number, who, handover, datetime(2024, month, 28, loaded), "clash", 7)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions(spark):
    d = date(2024, 1, 5)
    df = spark.createDataFrame(
        [
            snap(1, 1, "A", "Ana  Anić", d), snap(2, 2, "A", " ana anić", d), snap(3, 4, "A", "ANA ANIĆ", d),  # a month missing, other spelling
            snap(4, 5, "A", None), snap(5, 6, "A", ""), snap(6, 7, "A", "Ana Anić", d),  # in store, then undone
            snap(7, 8, "A", "wrong", d, 1), snap(8, 8, "A", "Ana Anić", d, 2),  # corrected later
            snap(9, 1, "B", "x"), snap(9, 1, "B", "x"),  # repeated row
        ],
        SCHEMA,
    )
    assert rows(p2_found(df)) == [
        ("A", "2024-01-28", "2024-05-28"), ("A", "2024-05-28", "2024-07-28"), ("A", "2024-07-28", ""), ("B", "2024-01-28", ""),
    ]
    counts = {(r["inventory_number"], r["version_no"]): r["n_snapshots"] for r in register_history(df).collect()}
    assert counts == {("A", 1): 3, ("A", 2): 2, ("A", 3): 2, ("B", 1): 1}


def test_handover_date_counts_and_null_equals_null(spark):
    df = spark.createDataFrame([snap(1, 1, "A", "x", date(2024, 1, 1)), snap(2, 2, "A", "x", None), snap(3, 3, "A", "x", None)], SCHEMA)
    assert [r[1:] for r in rows(p2_found(df))] == [("2024-01-28", "2024-02-28"), ("2024-02-28", "")]


def test_nulls_empty_and_ties(spark):
    df = spark.createDataFrame([snap(1, 1, None, "x"), (2, None, "A", "x", None, None, "c", 1), (None, date(2024, 1, 28), "A", None, None, None, None, None)], SCHEMA)
    assert rows(p2_found(df)) == [("A", "2024-01-28", "")]
    assert rows(p2_found(df.limit(0))) == []
    tie = spark.createDataFrame([snap(1, 1, "A", "x"), snap(2, 1, "A", "y")], SCHEMA)
    assert register_history(tie).first()["holder"] == "y"


def test_many_versions_against_a_loop(spark):
    import random

    random.seed(3)
    data = [(e, d, random.choice("xyz"), d) for e in range(20) for d in range(60) if random.random() < 0.8]
    df = spark.createDataFrame(data, "e int, d int, v string, l int")
    got = rows(attribute_history(df, "e", "d", "l", {"v": F.col("v")}).select("e", "valid_from", "valid_to", "v"))
    expected = []
    for e in range(20):
        own = sorted((d, v) for x, d, v, _ in data if x == e)
        starts = [(d, v) for i, (d, v) in enumerate(own) if i == 0 or own[i - 1][1] != v]
        expected += [(e, d, starts[i + 1][0] if i + 1 < len(starts) else None, v) for i, (d, v) in enumerate(starts)]
    assert got == sorted(expected)
