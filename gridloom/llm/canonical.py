"""Mapping free-entered values to a canonical list.

Reference entries and their alias paths (other word orders, abbreviated and
cut words, parts that name one entry only) form a trie; every distinct value is
searched in it with a Levenshtein automaton within a distance that depends on
its length. Values without an entry are reported with 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.folding import plain_latin
from gridloom.llm.fuzzytrie import POINT, NameTrie, Trie, closest
from gridloom.session import cut_lineage

#: Words that describe the state or outfit of an item, not what it is.
QUALIFIERS = (
    "nov nova novo novi polovan polovna polovno rabljeno rabljen rabljena koriscen korisceno kom komad kompl komplet "
    "crni crna crno beli bela belo sivi siva sivo servisiran servisirana ispravan neispravan ostecen otpisan"
).split()
_OUTFIT = re.compile(r"\bsa? (?:adapterom|torbom|punjacem|kablom|kutijom|postoljem|baterijom|garancijom)\b")
_SPECS = re.compile(r"\bi[3579](?:/\d+ ?gb)?\b|(?<![a-z\d])\d+(?:[.,]\d+)? ?(?:gb|tb|mb|in|inch|ghz|mhz|hz|kg|w|v|mah)\b|\d+(?:[.,]\d+)?\"")
_QUALIFIER = re.compile(r"\b(?:" + "|".join(QUALIFIERS) + r")\b\.?")
_FILLERS = re.compile(r"\b(?:sa|s|za|od|i)\b")
#: Letters of other spellings of one sound, so that both scripts meet.
_SOUNDS = (("qu", "ku"), ("q", "k"), ("x", "ks"), ("w", "v"), ("y", "j"))


def _sounds(text: str) -> str:
    for a, b in _SOUNDS:
        text = text.replace(a, b)
    return text


def _path(words: Sequence[str]) -> str:
    return "".join(words)


def _key(text: str) -> str:
    """Letters and digits without blanks; a point stays only after an abbreviated word."""
    text = re.sub(r"(?<=[^\W\d])\.", POINT, re.sub(r"(?<=\d)[.,](?=\s|$)", " ", text))
    return re.sub(rf"[^\w{POINT}]|_", "", text)


def readings(value: str) -> list[str]:
    """Ways to read a typed value, the fullest first: with and without fillers and qualifiers."""
    base = _sounds(re.sub(r"\s+", " ", plain_latin(value)).strip())
    bare = _QUALIFIER.sub(" ", _SPECS.sub(" ", _OUTFIT.sub(" ", base)))
    head = re.split(r"[(/,]| - ", bare, maxsplit=1)[0]
    keys = [_key(t) for text in (base, bare) for t in (text, _FILLERS.sub(" ", text))] + [_key(head)]
    keys += [k.rstrip(POINT) for k in keys]
    return list(dict.fromkeys(k for k in keys if k))


def _words(name: str) -> list[str]:
    return [_sounds(re.sub(r"[\W_]", "", w)) for w in plain_latin(name).split()]


def name_words(name: str) -> list[str]:
    """The words of a name, fillers left out."""
    return [w for w in _words(_FILLERS.sub(" ", plain_latin(name))) if w]


def name_trie(listed: pd.DataFrame) -> Trie:
    """Names with the words that they alone have (columns ``ref``, ``name``, ``own``)."""
    trie = NameTrie()
    for ref, name, own in zip(listed["ref"], listed["name"], listed["own"], strict=True):
        trie.add_name(int(ref), name_words(name or ""), {w for w in (() if own is None else own) if len(w) >= 4})
    return trie


def named(reference: DataFrame, ref_id: str, name: str) -> DataFrame:
    """``ref, name, own``: names with those of their words that no other entry of the whole list has."""
    listed = reference.select(F.col(f"`{ref_id}`").cast("bigint").alias("ref"), F.col(f"`{name}`").alias("name"))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r, w) for r, n in zip(pdf["ref"], pdf["name"], strict=True) for w in set(name_words(n or ""))]
            yield pd.DataFrame(rows, columns=["ref", "word"])

    found = listed.where("ref IS NOT NULL").mapInPandas(words, "ref bigint, word string").distinct()
    single = found.groupBy("word").agg(F.min("ref").alias("ref"), F.count(F.lit(1)).alias("n")).where("n = 1")
    own = single.groupBy("ref").agg(F.array_sort(F.collect_list("word")).alias("own"))
    return listed.join(own, "ref", "left")


def model_paths(brands: Sequence[str | None], models: Sequence[str | None]) -> list[list[tuple[str, float]]]:
    """Alias paths of models named brand, series, number and perhaps a suffix.

    The brand may be whole, cut short with a point, reduced to its consonants, last,
    or missing; the number may stand before the series.
    """
    out = []
    for brand, model in zip(brands, models, strict=True):
        head = _words(brand or "")
        rest = _words(model or "")[len(head) :]
        b = _path(head)
        series, number, suffix = rest[0] if rest else "", rest[1] if len(rest) > 1 else "", _path(rest[2:])
        tail = series + number + suffix
        consonants = re.sub(r"[aeiou]", "", b)
        marks = [(b, 0.0)] + [(b[:k] + POINT, 0.1) for k in range(2, len(b))] + [(consonants[:k] + POINT, 0.2) for k in (3, 4, 5)]
        paths: dict[str, float] = {tail: 0.2}
        for m, c in marks:
            for key, extra in ((m + tail, 0.0), (tail + m, 0.1), (m + number + series + suffix, 0.1)):
                paths[key] = min(c + extra, paths.get(key, 9.0))
        out.append(list(paths.items()))
    return out


def model_trie(listed: pd.DataFrame) -> Trie:
    """Models with their brand (columns ``ref``, ``brand``, ``model``)."""
    trie = Trie()
    for ref, own in zip(listed["ref"], model_paths(list(listed["brand"]), list(listed["model"])), strict=True):
        for path, cost in own:
            trie.add(path, int(ref), cost)
    return trie


def map_values(values: DataFrame, listed: DataFrame, build: Callable[[pd.DataFrame], Trie], block: int = 20_000) -> DataFrame:
    """``values`` (column ``value``, distinct) with ``ref_id`` and ``distance``; 0 and null where nothing fits.

    ``listed`` has the entries by ``ref``. A list of more than ``block`` entries is read
    in blocks, in the order of ``ref``: one block at a time is at the driver and on its
    way to the tasks, which build its trie, and the best of all blocks, by edits, then
    distance, then identifier, is kept, as if the list were one.
    """
    spark = values.sparkSession
    listed = listed.where(F.col("ref").isNotNull())
    n = listed.count()
    bounds: list[int | None] = [None]
    if n > block:
        listed = cut_lineage(listed)
        cuts = [i * block / n for i in range(1, -(-n // block))]
        bounds = [None, *sorted({int(x) for x in listed.approxQuantile("ref", cuts, 0.0)})]
    # As many tasks as cores: the work is in the search, not in the bytes.
    values = values.repartition(spark.sparkContext.defaultParallelism, "value")
    keep = [c for c in values.columns if c != "value"]
    found: DataFrame | None = None
    for i, lo in enumerate(bounds):
        part = listed if lo is None else listed.where(F.col("ref") > lo)
        if i + 1 < len(bounds):
            part = part.where(F.col("ref") <= bounds[i + 1])
        entries = part.orderBy(*part.columns).toPandas()  # at most a block

        def search(batches: Iterator[pd.DataFrame], entries: pd.DataFrame = entries) -> Iterator[pd.DataFrame]:
            trie = build(entries)
            known: dict[tuple[str, ...], tuple[int, int, float] | None] = {}
            for pdf in batches:
                hits = []
                for v in pdf["value"]:
                    q = tuple(readings(v))
                    if q not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[q] = closest(trie, q)
                    hits.append(known[q] or (9, 0, None))
                yield pdf.assign(edits=[h[0] for h in hits], ref_id=[h[1] for h in hits], distance=pd.array([h[2] for h in hits], "Float64"))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema.fields)
        one = values.mapInPandas(search, f"{schema}, edits int, ref_id bigint, distance double")
        if len(bounds) > 1:
            one = cut_lineage(one)
        found = one if found is None else found.unionByName(one)
    if len(bounds) > 1:
        best = F.min_by(F.struct("ref_id", "distance"), F.struct("edits", "distance", "ref_id"))
        found = found.groupBy("value", *keep).agg(best.alias("b")).select("value", *keep, "b.ref_id", "b.distance")
    return found.select("value", *keep, "ref_id", "distance")


def map_field(df: DataFrame, row_id: str, field: str, mapping: Callable[[DataFrame], DataFrame], hot_share: int = 1000) -> DataFrame:
    """One row for every value with a letter or digit: ``field_name, row_id, value, ref_id, distance``.

    Null, empty and blank values and dashes give no row; very long values are searched
    whole and match nothing; repeated rows are mapped alike; an empty list maps every
    value to 0 and an empty table gives no rows. Other columns are ignored.

    Scale: only distinct values are searched (combined before the shuffle). Values with
    at least ``1 / hot_share`` of all rows are at most ``hot_share`` in number: they go
    to the rows by broadcast, so their rows are not moved at all; the others are joined.
    """
    rows = df.select(F.col(f"`{row_id}`").alias("_id"), F.col(f"`{field}`").alias("value")).where(F.col("value").rlike(r"[\p{L}\p{N}]"))
    mapped = cut_lineage(mapping(rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))))
    total = mapped.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * hot_share >= total
    frequent = F.broadcast(mapped.where(hot).drop("n"))  # at most hot_share values
    joined = rows.join(frequent, "value").unionByName(rows.join(frequent.select("value"), "value", "left_anti").join(mapped.where(~hot).drop("n"), "value"))
    return joined.select(F.lit(field).alias("field_name"), F.col("_id").alias("row_id"), "value", "ref_id", "distance")


def p6_found(equipment: DataFrame, types: DataFrame, models: DataFrame) -> DataFrame:
    kinds = named(types, "type_id", "type_name")
    series = models.select(F.col("model_id").cast("bigint").alias("ref"), "brand", F.col("model_name").alias("model"))
    kind = map_field(equipment, "item_id", "equipment_type", lambda v: map_values(v, kinds, name_trie))
    model = map_field(equipment, "item_id", "model", lambda v: map_values(v, series, model_trie))
    return kind.unionByName(model).select("field_name", F.col("row_id").alias("item_id"), "ref_id")
