from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from gridloom.llm import canonical
from gridloom.llm.fuzzytrie import POINT, NameTrie, Trie, closest, edit_distance, length_dependent_edits

TYPES = ["Stoni računar", "Prenosni računar", "Monitor", "Tablet", "Mrežni svič", "Bar-kod čitač", "Čitač kartica", "Slušalice sa mikrofonom"]
MODELS = [("Velmaro", "Velmaro Terranova 37"), ("Velmaro", "Velmaro Terranova 21 Pro"), ("Tektunis", "Tektunis Quibex 400")]


def test_automaton_against_brute_force():
    random.seed(1)
    words = ["".join(random.choice("abc1") for _ in range(random.randint(1, 8))) for _ in range(120)]
    trie = Trie()
    for i, w in enumerate(words):
        trie.add(w, i)
    for _ in range(150):
        q = "".join(random.choice("abc1") for _ in range(random.randint(1, 8)))
        for k in range(4):
            truth = {i: edit_distance(q, w) for i, w in enumerate(words)}
            assert trie.search(q, k) == {i: d for i, d in truth.items() if d is not None and d <= k}


def test_length_dependent_distance():
    assert [length_dependent_edits("a" * n) for n in (3, 5, 12, 13)] == [0, 1, 2, 3]
    trie = Trie()
    trie.add("tablet", 1)
    assert closest(trie, ["tabla"]) is None and closest(trie, ["tabelt"]) == (1, 1, 1.0) and closest(trie, [""]) is None


def frames(spark, values):
    df = spark.createDataFrame([(i, v, "c") for i, v in enumerate(values)], "item_id bigint, equipment_type string, value string")
    types = spark.createDataFrame([(i + 1, t) for i, t in enumerate(TYPES)], "type_id bigint, type_name string")
    return df, types


def mapped_to(types, block=20_000):
    return lambda v: canonical.map_values(v, canonical.named(types, "type_id", "type_name"), canonical.name_trie, block)


def types_of(spark, values, block=20_000):
    df, types = frames(spark, values)
    return {r["row_id"]: r["ref_id"] for r in canonical.map_field(df, "item_id", "equipment_type", mapped_to(types, block)).collect()}


def all_paths(words):
    """Brute force: every order of the words, every way to cut them, with the cost."""
    out = {}
    forms = [[(w, 0.0)] + [(w[:k] + POINT, 0.1) for k in range(2, len(w))] + [(w[:k], 0.3) for k in range(5, len(w))] for w in words]
    if len(words) == 1:
        return {words[0]: 0.0}
    for order in itertools.permutations(range(len(words))):
        for combo in itertools.product(*(forms[i] for i in order)):
            path, cost = "".join(c[0] for c in combo), sum(c[1] for c in combo) + (0.0 if list(order) == sorted(order) else 0.05)
            out[path] = min(cost, out.get(path, 9.0))
    return out


def test_names_unfold_like_all_their_paths():
    random.seed(4)
    names = [["ab" * 3, "cd", "abc"], ["abcab"], ["dd", "dd"], ["abcdefg", "cab"], ["ba", "abab", "cb"]]
    lazy, full = NameTrie(held=50), Trie()
    for i, words in enumerate(names):
        lazy.add_name(i, words)
        for path, cost in all_paths(words).items():
            full.add(path, i, cost)
    paths = sorted(set().union(*map(all_paths, names)))
    for q in random.sample(paths, 60) + ["".join(random.choice("abcd" + POINT) for _ in range(random.randint(1, 9))) for _ in range(150)]:
        for k in range(3):
            want, got = full.search(q, k), lazy.search(q, k)
            assert want.keys() == got.keys() and all(abs(want[i] - got[i]) < 1e-9 for i in want)


def test_many_words_are_held_as_words():
    words = "veoma dugacak naziv jedne police koja ima mnogo reci".split()
    trie = NameTrie()
    trie.add_name(7, words)
    random.seed(6)
    for _ in range(5):
        other = random.sample(words, len(words))
        assert closest(trie, ["".join(other)])[1] == 7
    assert closest(trie, ["veo․dugacaknaz․jednepolicekojaimamno․reci"])[1] == 7
    assert len(trie.children) < 20_000


def test_the_answer_does_not_depend_on_the_block(spark):
    values = ["čitač", "čitač kartica", "kartica", "bar-kod", "stoni", "monitr", "računar", "mrezni", "tablet x", "prenosni st."]
    assert types_of(spark, values, 1) == types_of(spark, values, 3) == types_of(spark, values)
    df = spark.createDataFrame([("čitač",)], "value string")
    few = spark.createDataFrame([(1, "Bar-kod čitač"), (2, "Čitač kartica"), (3, "Monitor stoni")], "type_id bigint, type_name string")
    assert [[r["ref_id"] for r in mapped_to(few, b)(df).collect()] for b in (1, 2, 20_000)] == [[0], [0], [0]]


def test_search_is_more_than_one_task(spark):
    df, types = frames(spark, [f"monitor {i}" for i in range(200)])
    assert mapped_to(types)(df.select(F.col("equipment_type").alias("value"))).rdd.getNumPartitions() > 1


def test_hot_values_are_joined_once_each(spark):
    df, types = frames(spark, ["Monitor"] * 50 + ["Tablet"] * 3 + [f"razno {i}" for i in range(60)])
    got = canonical.map_field(df, "item_id", "equipment_type", mapped_to(types), hot_share=10).collect()
    assert len(got) == 113 and sum(r["ref_id"] == 3 for r in got) == 50 and sum(r["ref_id"] == 4 for r in got) == 3


def test_types(spark):
    cases = {
        "STONI RACUNAR": 1, "računar stoni": 1, "st. računar": 1, "prenosni rač.": 2, "Prennosni računar (nov)": 2, "Монитор": 3, "monitr - polovan": 3,
        "svič": 5, "barkod čitač": 6, "čitač za kartice": 7, "slušalice+mikrofon": 8, "Tabla za pisanje": 0, "Aparat za kafu": 0, "Monitоr": 3, "razno": 0,
    }
    got = types_of(spark, list(cases))
    assert {v: got[i] for i, v in enumerate(cases)} == cases
    assert types_of(spark, list(cases), block=3) == got


def test_models(spark):
    listed = spark.createDataFrame([(i + 1, b, m) for i, (b, m) in enumerate(MODELS)], "ref bigint, brand string, model string")
    cases = {"VELM. TERRANOVA 37": 1, "terranova21 pro": 2, "Tektunis, 400 Quibex": 3, "Ћуибек": 0, "quibex 400 (tektunis) crni": 3, "Velmaro Terranova 38": 0, "Терранова 37": 1, "Quibx 400 i5/8gb": 3}
    df = spark.createDataFrame([(v,) for v in cases], "value string")
    got = canonical.map_values(df, listed, canonical.model_trie).collect()
    assert {r["value"]: r["ref_id"] for r in got} == cases


def test_degenerate(spark):
    assert types_of(spark, [None, "", " ", "-", "x" * 50_000, "Monitor", "Monitor"]) == {4: 0, 5: 3, 6: 3}
    df, types = frames(spark, ["Monitor"])
    nothing = mapped_to(types.limit(0))(df.select("value"))
    assert [r["ref_id"] for r in nothing.collect()] == [0]
    assert canonical.map_field(df.limit(0), "item_id", "equipment_type", lambda v: v.selectExpr("value", "n", "0L AS ref_id", "0D AS distance")).count() == 0
