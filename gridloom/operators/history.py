"""History of changing entity attributes, from periodic snapshots.

Each entity's snapshots become one sorted array of structs, folded once by a
higher-order function that appends a version only when the tracked attributes
change; the versions are then exploded with the start of the next one as end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks in the wide sense: ASCII white space and the Unicode space separators.
BLANKS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+"


def loose_text(col: Column) -> Column:
    """Case and surplus blanks do not count; null equals the empty text."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), BLANKS, " ")))


def attribute_history(
    snapshots: DataFrame,
    entity: str,
    at: str,
    loaded: str,
    tracked: Mapping[str, Column],
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Versions of every entity with the period for which each held.

    ``tracked`` names the compared attributes. Of several rows for one entity and
    date the one with the greatest (``loaded``, ``tie_break``..., attributes)
    counts, nulls lowest, so repeated rows and ties give one defined result. A
    missing date does not end a version. Rows without entity or date describe no
    version of anything and give none; an empty table gives no rows. Further
    columns of the input are ignored, whatever their names.

    Returns ``entity, version_no, valid_from, valid_to, n_snapshots`` and the
    tracked attributes; ``valid_to`` is null for the last version.

    Scale: the first aggregation is keyed by (entity, date) and combines before
    the shuffle, so an entity with a third of all rows still sends at most one
    row per date and input partition. The array of one entity is bounded by the
    number of distinct dates, not by its rows.
    """
    key, when = F.col(f"`{entity}`"), F.col(f"`{at}`")
    rows = snapshots.where(key.isNotNull() & when.isNotNull()).select(
        key.alias("_entity"),
        when.alias("_at"),
        F.struct(
            F.col(f"`{loaded}`").alias("l"),
            *(F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(tie_break)),
            F.struct(*(c.alias(n) for n, c in tracked.items())).alias("a"),
        ).alias("_row"),
    )
    daily = rows.groupBy("_entity", "_at").agg(F.max("_row").getField("a").alias("_a"))
    attrs_type = daily.schema["_a"].dataType.simpleString()
    at_type = daily.schema["_at"].dataType.simpleString()
    start = F.expr(f"cast(array() as array<struct<f:{at_type},n:bigint,a:{attrs_type}>>)")

    def step(versions: Column, day: Column) -> Column:
        last = F.try_element_at(versions, F.lit(-1))

        def version(since: Column, seen: Column) -> Column:
            return F.array(F.struct(since.alias("f"), seen.alias("n"), day["_a"].alias("a")))

        longer = F.concat(F.slice(versions, 1, F.size(versions) - 1), version(last["f"], last["n"] + 1))
        fresh = F.concat(versions, version(day["_at"], F.lit(1).cast("bigint")))
        return F.when((F.size(versions) > 0) & last["a"].eqNullSafe(day["_a"]), longer).otherwise(fresh)

    folded = daily.groupBy("_entity").agg(F.sort_array(F.collect_list(F.struct("_at", "_a"))).alias("_days")).select(
        "_entity", F.aggregate("_days", start, step).alias("_v")
    )
    closed = folded.select(
        "_entity",
        F.posexplode(
            F.transform("_v", lambda v, i: F.struct(v["f"].alias("f"), F.try_element_at(F.col("_v"), i + 2)["f"].alias("t"), v["n"].alias("n"), v["a"].alias("a")))
        ).alias("_i", "_x"),
    )
    return closed.select(
        F.col("_entity").alias(entity),
        (F.col("_i") + 1).cast("bigint").alias("version_no"),
        F.col("_x.f").alias("valid_from"),
        F.col("_x.t").alias("valid_to"),
        F.col("_x.n").alias("n_snapshots"),
        *(F.col(f"_x.a.`{n}`").alias(n) for n in tracked),
    )


def register_history(snapshots: DataFrame) -> DataFrame:
    """Who held each inventory number, and since which handover."""
    return attribute_history(
        snapshots,
        entity="inventory_number",
        at="snapshot_date",
        loaded="loaded_at",
        tracked={"holder": loose_text(F.col("received_by")), "handover_date": F.col("handover_date")},
        tie_break=("snap_row_id",),
    )


def p2_found(snapshots: DataFrame) -> DataFrame:
    return register_history(snapshots).select(
        "inventory_number",
        F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"),
        F.coalesce(F.date_format("valid_to", "yyyy-MM-dd"), F.lit("")).alias("valid_to"),
    )
