"""Queries of this subpackage, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import canonical, copies, lookalike, mixing, names, packing, sentences, units
from gridloom.llm.tokens import public_tokenizer
from gridloom.session import table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    forms = table(spark, base, "forms")
    people = names.resolve_people(
        names.spellings(forms, ["person_name", "handed_over_by", "received_by"]), table(spark, base, "given_names"), names.seen_together(forms)
    )
    places = units.resolve_units(names.spellings(forms, ["organization_unit"]))
    return names.pairs_of(people, "person").unionByName(names.pairs_of(places, "unit"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return lookalike.p3_found(table(spark, base, "words"), table(spark, base, "equipment"), table(spark, base, "forms"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return copies.p5_found(table(spark, base, "equipment"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return canonical.p6_found(
        table(spark, base, "equipment"), table(spark, base, "equipment_types"), table(spark, base, "equipment_models")
    )


def p7_pack(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack(table(spark, base, "documents"), table(spark, base, "containers"), public_tokenizer())


def p7_fill(spark: SparkSession, base: str) -> DataFrame:
    return packing.fill_report(p7_pack(spark, base))


def p8_mix(spark: SparkSession, base: str) -> DataFrame:
    return mixing.draw(table(spark, base, "documents"), table(spark, base, "mix_targets"), public_tokenizer())


def p8_shares(spark: SparkSession, base: str) -> DataFrame:
    return mixing.shares_report(p8_mix(spark, base), table(spark, base, "mix_targets"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return sentences.p9_found(table(spark, base, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p7_pack": p7_pack,
    "p7_fill": p7_fill,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
}

ORACLE = {
    "p5_found": r"""
WITH t AS (
  SELECT item_id,
         lower(regexp_replace(coalesce(equipment_type, ''), '[^\p{L}\p{Nd}]', '', 'g')) AS a,
         lower(regexp_replace(coalesce(model, ''), '[^\p{L}\p{Nd}]', '', 'g')) AS b,
         lower(regexp_replace(coalesce(quantity, ''), '[^\p{L}\p{Nd}]', '', 'g')) AS c,
         lower(regexp_replace(coalesce(serial_number, ''), '[^\p{L}\p{Nd}]', '', 'g')) AS s,
         lower(regexp_replace(coalesce(inventory_number, ''), '[^\p{L}\p{Nd}]', '', 'g')) AS i
  FROM equipment)
SELECT min(item_id) AS item_id, count(*) AS n_copies
FROM t WHERE s <> '' OR i <> ''
GROUP BY a, b, c, CASE WHEN s < i THEN s ELSE i END, CASE WHEN s < i THEN i ELSE s END
HAVING count(*) > 1""",
}
