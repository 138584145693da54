"""Duplicates hidden by formatting differences, collapsed and counted.

Records with one canonical key are copies. Keys that are hot are found exactly
from partial counts; their rows go through a salted two-level aggregation, all
others through one shuffle. The representative is the smallest identifier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def letters_and_digits(col: Column) -> Column:
    """Only letters and digits, case levelled; null equals empty."""
    return F.lower(F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), r"[^\p{L}\p{Nd}]", ""))


def canonical_key(plain: Sequence[str], either_order: Sequence[str]) -> Column:
    """256-bit key over fields in fixed places and fields that may be exchanged.

    Parts are joined by a character no part can contain, so different records
    cannot meet in one key.
    """
    fixed = [letters_and_digits(F.col(f"`{c}`")) for c in plain]
    loose = F.sort_array(F.array(*(letters_and_digits(F.col(f"`{c}`")) for c in either_order)))
    return F.unhex(F.sha2(F.concat_ws("\x1f", F.array(*fixed), loose), 256))


def collapse_copies(
    df: DataFrame,
    row_id: str,
    plain: Sequence[str],
    either_order: Sequence[str],
    hot_share: float = 1 / 2048,
    salts: int = 64,
) -> DataFrame:
    """One row per record: ``representative, n_copies, canonical_key``.

    Rows without a letter or digit in all of ``either_order`` identify no record and
    are left out; nulls equal the empty text; repeated rows count as copies; between
    copies the smallest identifier represents. An empty table gives no rows, and
    further columns are ignored whatever their names.

    Scale: partial counts per input partition make one row per key and partition.
    A key is hot if it holds more than ``hot_share`` of all rows, so there are fewer
    than ``1 / hot_share`` hot keys of 32 bytes whatever the data, and only these are
    broadcast. Hot rows are spread over ``salts`` groups first; no row is dropped.
    """
    keyed = df.select(
        F.col(f"`{row_id}`").alias("_id"),
        canonical_key(plain, either_order).alias("_key"),
        F.concat(*(letters_and_digits(F.col(f"`{c}`")) for c in either_order)).alias("_any"),
    ).where(F.col("_any") != "").drop("_any")
    total = keyed.agg(F.count(F.lit(1))).first()[0]
    partial = keyed.groupBy("_key", F.spark_partition_id().alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    counts = partial.groupBy("_key").agg(F.sum("_n").alias("_n"))
    hot = F.broadcast(counts.where(F.col("_n") > F.lit(max(1.0, total * hot_share))).select("_key"))
    cold_side = (
        keyed.join(hot, "_key", "left_anti").groupBy("_key").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    )
    salted = keyed.join(hot, "_key", "left_semi").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)))
    hot_side = (
        salted.groupBy("_key", "_salt")
        .agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
        .groupBy("_key")
        .agg(F.min("_id").alias("_id"), F.sum("_n").alias("_n"))
    )
    return cold_side.unionByName(hot_side).select(
        F.col("_id").alias("representative"), F.col("_n").cast("bigint").alias("n_copies"), F.hex("_key").alias("canonical_key")
    )


def p5_found(equipment: DataFrame) -> DataFrame:
    records = collapse_copies(
        equipment, "item_id", ("equipment_type", "model", "quantity"), ("serial_number", "inventory_number")
    )
    return records.where(F.col("n_copies") > 1).select(F.col("representative").alias("item_id"), "n_copies")
