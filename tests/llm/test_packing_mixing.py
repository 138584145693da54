from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import mixing, packing
from gridloom.llm.tokens import count_tokens, counter, public_tokenizer


def test_closest_multiset_against_all_subsets():
    random.seed(2)
    for _ in range(60):
        counts = Counter(random.randint(1, 12) for _ in range(8))
        space = random.randint(1, 40)
        items = list(counts.elements())
        best = max(s for n in range(9) for c in itertools.combinations(items, n) if (s := sum(c)) <= space)
        chosen = packing.closest_multiset(sorted(counts), dict(counts), space)
        assert sum(k * v for k, v in chosen.items()) == best and all(v <= counts[k] for k, v in chosen.items())


def test_window_is_filled_once_each():
    random.seed(3)
    sizes = np.array([random.choice([0, 1, 5, 33, 64, 100]) for _ in range(400)])
    container, place = packing.fill_window(sizes, 100)
    used = Counter()
    for c, s in zip(container, sizes, strict=True):
        used[c] += s
    assert max(used.values()) <= 100 and len(set(zip(container, place, strict=True))) == 400
    assert len(used) <= -(-sizes.sum() // 100) * 1.05 + 1


@pytest.fixture(scope="module")
def containers(request):
    spark = request.getfixturevalue("spark")
    return spark.createDataFrame([("s", 8), ("l", 64)], "container_kind string, capacity_tokens int")


def docs_frame(spark, texts, sources=None):
    rows = [(i, t, (sources or ["a"] * len(texts))[i], "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, kind string, place int")


def test_pack_is_a_partition_of_every_text(spark, containers):
    random.seed(5)
    texts = [" ".join(random.choice(["word", "pump", "lantern"]) for _ in range(random.randint(0, 150))) for _ in range(80)] + [None, "", "x " * 5000]
    df = docs_frame(spark, texts)
    sizes = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, "text", public_tokenizer(), ("doc_id",)).collect()}
    got = packing.pack(df, containers, public_tokenizer(), window=30).collect()
    for kind, capacity in (("s", 8), ("l", 64)):
        used, seen, places = Counter(), {}, set()
        for r in (r for r in got if r["container_kind"] == kind):
            used[r["container_id"]] += r["end_token"] - r["start_token"]
            seen.setdefault(r["doc_id"], []).append((r["start_token"], r["end_token"]))
            places.add((r["container_id"], r["place"]))
        assert max(used.values()) <= capacity and len(places) == sum(map(len, seen.values()))
        assert set(seen) == set(sizes)
        for d, parts in seen.items():
            parts.sort()
            assert parts[0][0] == 0 and parts[-1][1] == sizes[d] and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
            assert len(parts) == max(1, -(-sizes[d] // capacity))
    for r in packing.fill_report(packing.pack(df, containers, public_tokenizer())).collect():
        # A few dozen rests of any size cannot always be matched exactly; windows of thousands can.
        assert r["n_containers"] <= -(-r["n_tokens"] // r["capacity_tokens"]) * 1.02 + 1
    assert packing.pack(df.limit(0), containers, public_tokenizer()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, containers.selectExpr("container_kind", "0 AS capacity_tokens"), public_tokenizer())


def test_token_counts_of_all_libraries(spark):
    texts = ["Hello  world <|endoftext|>", "Љубав 東京", ""]
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        assert counter(public_tokenizer(name))(texts)[2] == 0
    assert counter(public_tokenizer("byte_bpe_50k.tiktoken"))(texts) == counter(public_tokenizer("byte_bpe_50k.json"))(texts)


TARGETS = "source string, target_share double, max_repeats int"


def test_mix_meets_shares_and_caps(spark):
    random.seed(8)
    sources = ["big"] * 600 + ["mid"] * 200 + ["small"] * 40 + ["other"] * 20 + [None, ""]
    texts = [" ".join(["pump"] * random.randint(1, 60)) for _ in sources]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.28, 2), ("small", 0.2, 4), ("none", 0.02, 2), ("other", 0.0, 1)], TARGETS)
    got = mixing.draw(docs_frame(spark, texts, sources), targets, public_tokenizer(), block=100)
    report = {r["source"]: r for r in mixing.shares_report(got, targets).collect()}
    for s, share in (("big", 0.5), ("mid", 0.28), ("small", 0.2)):
        assert abs(report[s]["reached_share"] / (share / 0.98) - 1) < 0.01
        assert report[s]["most_uses"] <= {"big": 1, "mid": 2, "small": 4}[s]
    assert report["none"]["n_docs"] == report["other"]["n_docs"] == 0
    whole = sum(r["n_tokens"] for r in report.values())
    assert abs(report["big"]["n_tokens"] / whole - report["big"]["reached_share"]) < 1e-9
    assert got.select("doc_id").distinct().count() == got.count()


def test_dual_with_binding_caps(spark):
    sized = spark.createDataFrame([(i, "s", 10 + i, 0.5 + i) for i in range(10)], "doc_id bigint, source string, n_tokens bigint, base_rate double")
    for goal in (1.0, 60.0, 150.0, 270.0, 289.0):
        dual, gaps = mixing.solve_dual(sized, {"s": goal}, {"s": 2})
        drawn = sum((10 + i) * min(2.0, (0.5 + i) * np.exp(dual["s"] * (10 + i))) for i in range(10))
        assert abs(drawn / goal - 1) < 1e-8 and gaps[-1] < 1e-8 and 2 < len(gaps) < 60
    # Where every cap binds no finite multiplier is left.
    assert mixing.solve_dual(sized, {"s": 290.0}, {"s": 2}) == ({"s": np.inf}, [])


def test_dual_that_does_not_converge_is_an_error(spark):
    sized = spark.createDataFrame([(i, "s", 10 + i, 1.0) for i in range(10)], "doc_id bigint, source string, n_tokens bigint, base_rate double")
    with pytest.raises(RuntimeError, match="gap"):
        mixing.solve_dual(sized, {"s": 20.0}, {"s": 1}, rounds=2)


def test_rates_are_tilted_within_a_source(spark):
    random.seed(9)
    sources = ["long"] * 300 + ["short"] * 300
    texts = [" ".join(["pump"] * random.randint(5, 90)) for _ in sources]
    targets = spark.createDataFrame([("long", 0.8, 2), ("short", 0.2, 1)], TARGETS)
    got = mixing.draw(docs_frame(spark, texts, sources), targets, public_tokenizer(), block=50).collect()
    rates = {r["n_tokens"]: r["rate"] for r in got if r["source"] == "short"}
    sizes = sorted(rates)
    # The logarithm of the rate is straight in the size.
    slopes = [np.log(rates[b] / rates[a]) / (b - a) for a, b in itertools.pairwise(sizes)]
    assert len(set(rates.values())) > 10 and max(slopes) - min(slopes) < 1e-9 and abs(slopes[0]) > 1e-4


def test_rounding_keeps_tokens_and_bounds():
    random.seed(10)
    for _ in range(50):
        tokens = np.array(sorted((random.randint(1, 400) for _ in range(60)), reverse=True))
        rates = np.array([random.uniform(0, 3) for _ in tokens])
        uses = mixing.round_by_tokens(rates, tokens)
        assert ((uses == np.floor(rates)) | (uses == np.ceil(rates))).all()
        assert abs((uses * tokens).sum() - (rates * tokens).sum()) <= 20


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_shares_of_the_test_tables(spark, sf):
    from gridloom.llm.catalog import p8_mix
    from gridloom.session import table

    targets = table(spark, f"/root/testdata/{sf}", "mix_targets")
    mix = p8_mix(spark, f"/root/testdata/{sf}").cache()
    assert mix.groupBy("source").agg({"rate": "stddev"}).where("source <> '' AND `stddev(rate)` > 0").count() >= 5
    report = mixing.shares_report(mix, targets).collect()
    met = sum(r["target_share"] for r in report if r["n_docs"])
    for r in report:
        assert r["most_uses"] <= r["max_repeats"]
        if r["n_docs"]:
            assert abs(r["reached_share"] * met / r["target_share"] - 1) < 0.01


def test_nothing_to_mix(spark):
    df = docs_frame(spark, ["a b", None], ["a", "a"])
    assert mixing.draw(df, spark.createDataFrame([("z", 1.0, 1), (None, 0.5, 1)], TARGETS), public_tokenizer()).count() == 0
    assert mixing.draw(df.limit(0), spark.createDataFrame([("a", 1.0, 1)], TARGETS), public_tokenizer()).count() == 0
    one = mixing.draw(df, spark.createDataFrame([("a", 1.0, 3)], TARGETS), public_tokenizer()).collect()
    assert [(r["doc_id"], r["n_uses"], r["reached_share"]) for r in one] == [(0, 3, 1.0)]
