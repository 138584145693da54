from __future__ import annotations

import random

import pytest

from gridloom.operators.multivalue import Lattice, SplitModel, p4_found, split_fields


def frame(spark, values):
    return spark.createDataFrame([(i, v, "pos") for i, v in enumerate(values)], "item_id bigint, serial_number string, pos string")


def run(spark, values, model=SplitModel(), hot_share=1000):
    out: dict[int, list] = {}
    for r in split_fields(frame(spark, values), "item_id", ["serial_number"], model, hot_share).collect():
        out.setdefault(r["item_id"], []).append((r["pos"], r["item_value"]))
    return {k: sorted(v) for k, v in out.items()}


def codes(n, seed=1):
    random.seed(seed)
    return [f"SN/{random.randrange(10**8):08d}/{random.choice('ABCD')}{random.randrange(10)}" for _ in range(n)] + [
        f"KX 0000 {random.randrange(10**5):05d}" for _ in range(n)
    ]


def test_learned_split_against_a_known_grammar(spark):
    singles = codes(60)
    random.seed(2)
    lists, truth = [], {}
    separators = [", ", ";", " / ", "\n", " i ", " te ", " | ", " + ", "\t", ",\n"]
    for sep in separators:
        for _ in range(3):
            parts = random.sample(singles, random.randint(2, 5))
            lists.append(sep.join(parts))
            truth[len(singles) + len(lists) - 1] = [(k + 1, p) for k, p in enumerate(parts)]
    assert run(spark, singles + lists) == truth


def test_slots_quotes_and_numbering(spark):
    base = codes(40)
    a, b, c = base[:3]
    values = base + [f"{a};;{b}", f"{a}; ; {b};", f'"{a},1", "{b},2"', f"1) {a} 2) {b}", f"(1) {a}, (2) {b}", f"1: {a}\n2: {b}\n", f"„{a}“ „{b}“", f'"{c},x"', f"{a} || {b}"]
    n = len(base)
    got = run(spark, values)
    assert got == {
        n: [(1, a), (3, b)], n + 1: [(1, a), (3, b)], n + 2: [(1, f"{a},1"), (2, f"{b},2")], n + 3: [(1, a), (2, b)], n + 4: [(1, a), (2, b)],
        n + 5: [(1, a), (2, b)], n + 6: [(1, a), (2, b)], n + 8: [(1, a), (2, b)],
    }


def test_degenerate_fields(spark):
    assert run(spark, [None, "", " ", "-", "/", ";;;", "...", "—"]) == {}
    assert p4_found(spark.createDataFrame([], "item_id bigint, serial_number string, inventory_number string")).count() == 0
    long = ", ".join(f"AB{i:06d}" for i in range(4000))
    got = run(spark, [f"AB{i:06d}" for i in range(20)] + [long, long])
    assert len(got[20]) == 4000 and got[20] == got[21]


def test_expected_counts_are_consistent():
    lat = Lattice("xxxx, xxxx / xxxx", SplitModel())
    flat = lambda shape, inside: 0.5 * 0.1**inside if shape else 1e-3
    total = sum(lat.expected(flat).values())
    assert 1 <= total <= 3
    assert [x[0] for x in lat.best(flat)] == list(range(1, len(lat.best(flat)) + 1))


def test_shapes_joined_and_shapes_held_split_alike(spark):
    singles = codes(30, 4)
    random.seed(5)
    values = singles + [sep.join(random.sample(singles, 3)) for sep in (", ", " / ", " | ", " i ", ";") for _ in range(4)] + ["KX 0000  12", "a / b"]
    held = run(spark, values)
    assert run(spark, values, SplitModel(held=0)) == held and len(held) >= 20
    assert run(spark, values, hot_share=3) == held


def test_values_with_many_separators_stay_whole_where_their_shape_is_known(spark):
    long = [" ".join(f"{random.randrange(100):02d}" for _ in range(14)) for _ in range(60)]
    # Half of them quoted show what such a value looks like.
    got = run(spark, [f'"{v}"' for v in long[:30]] + long[30:] + ["AB123456", "AB123457, AB123458"])
    assert got == {61: [(1, "AB123457"), (2, "AB123458")]}


def test_rounds_without_an_end_are_an_error(spark):
    with pytest.raises(RuntimeError, match="settle"):
        run(spark, codes(20) + ["A1 B2 / C3", "A1 / B2 C3"], SplitModel(rounds=1, settled=0.0))
