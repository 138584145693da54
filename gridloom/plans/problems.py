"""Queries of the data-processing problems that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.operators import history, multivalue
from gridloom.session import table


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return history.p2_found(table(spark, base, "register_snapshots"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return multivalue.p4_found(table(spark, base, "equipment"))


QUERIES = {"p2_found": p2_found, "p4_found": p4_found}

#: The segmentation of p4 is learned, which SQL cannot express; tests hold it against a fixed grammar.
ORACLE = {
    "p2_found": r"""
WITH latest AS (
  SELECT inventory_number AS k, snapshot_date AS d, handover_date AS h,
         lower(trim(regexp_replace(coalesce(received_by, ''), '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS r,
         row_number() OVER (PARTITION BY inventory_number, snapshot_date
                            ORDER BY loaded_at DESC NULLS LAST, snap_row_id DESC NULLS LAST) AS rn
  FROM register_snapshots
  WHERE inventory_number IS NOT NULL AND snapshot_date IS NOT NULL),
seen AS (
  SELECT *, lag(r) OVER w AS r0, lag(h) OVER w AS h0, lag(d) OVER w AS d0
  FROM latest WHERE rn = 1 WINDOW w AS (PARTITION BY k ORDER BY d)),
starts AS (SELECT k, d FROM seen WHERE d0 IS NULL OR r0 <> r OR h0 IS DISTINCT FROM h)
SELECT k AS inventory_number, strftime(d, '%Y-%m-%d') AS valid_from,
       coalesce(strftime(lead(d) OVER (PARTITION BY k ORDER BY d), '%Y-%m-%d'), '') AS valid_to
FROM starts""",
}
