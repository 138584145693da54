from __future__ import annotations

import random

from pyspark.sql import functions as F

from gridloom.llm import names, units
from gridloom.llm.components import components
from gridloom.llm.fuzzytrie import edit_distance

GIVEN = [("Aleksandar", "Aca"), ("Svetlana", "Ceca"), ("Teodora", "Dora"), ("Jovan", "Joca")]
NAMES = ("Aleksandar", "Svetlana", "Teodora", "Jovan", "Petar", "Marko")
#: Twenty families of three: a given name meets more surnames than a surname given names.
OTHERS = [f"{NAMES[(i + k) % 6]} {a}{b}" for i, (a, b) in enumerate((a, b) for a in ("Brenu", "Glogi", "Toro", "Mavu", "Izor") for b in ("nikar", "racki", "lukolac", "taševin")) for k in (0, 2, 3)]


def people(spark, strings, together=None):
    df = spark.createDataFrame([(s, 1) for s in strings], "raw string, n bigint")
    given = spark.createDataFrame(GIVEN, "given_name string, short_form string")
    pairs = spark.createDataFrame(together, "raw_a string, raw_b string") if together else None
    out = names.pairs_of(names.resolve_people(df, given, pairs), "person").collect()
    return {(r["name_a"], r["name_b"]) for r in out}


def both(*strings):
    return {tuple(sorted((a, b))) for a in strings for b in strings if a < b}


def test_variants_of_one_person(spark):
    own = ["Svetlana Kovačevinski", "KOVAČEVINSKI, SVETLANA", "Светлана Ковачевински", "dr Ceca Kovacevinski", "Kovačevniski (B.) Svetlana", "SvetlanaKovačevinski", "Svеtlana Kovačevinski"]
    got = people(spark, OTHERS + own + ["(prezime i ime)", "nečitko", "-", "  "])
    assert both(*own) <= got
    assert all(set(p) <= set(own) for p in got)


def test_namesakes_stay_apart_and_initials_do_not_bridge(spark):
    own = ["Jovan Zerulečolanin", "Joca Zerulečolanin", "Teodora Zerulečolanin", "Dora Zerulečolanin"]
    got = people(spark, OTHERS + own + ["D. Zerulečolanin"])
    assert both(*own[:2]) <= got and both(*own[2:], "D. Zerulečolanin") <= got
    assert not any({own[0], own[2]} <= set(p) for p in got)
    assert tuple(sorted(("D. Zerulečolanin", own[0]))) not in got


def test_middle_initials_separate(spark):
    a, b, c = "Jovan A. Lopimabargac", "Jovan B. Lopimabargac", "Joca A. Lopimabargac"
    got = people(spark, OTHERS + [a, b, c])
    assert tuple(sorted((a, c))) in got and tuple(sorted((a, b))) not in got


def test_context_decides_between_two(spark):
    own = ["Teodora Planuninski", "Torza Planuninski", "T. Planuninski"]
    got = people(spark, OTHERS + own, [("T. Planuninski", "Torza Planuninski")])
    assert tuple(sorted(("T. Planuninski", "Torza Planuninski"))) in got


def test_every_namesake_meets_its_slip(spark):
    own = {m: f"Jovan {m}. Lopimabargac" for m in "ABCDEF"}
    slips = {"B": "Jovan B. Lopmabargac", "C": "Jovan C. Lopimabargc", "D": "Jovan D. Lopimbargac", "E": "Jovan E. Lopimabrgac"}
    got = people(spark, OTHERS + [*own.values(), *slips.values(), "Jovan Lopimabargac"])
    assert all(tuple(sorted((own[m], s))) in got for m, s in slips.items())
    # Who has no middle initial joins one of them and bridges none.
    assert not any({own[a], own[b]} <= set(p) for p in got for a in own for b in own if a < b)
    assert sum("Jovan Lopimabargac" in p and set(p) & set(own.values()) != set() for p in got) == 1


def test_eight_namesakes_and_their_slips(spark):
    """Initials A to H, one slip each: eight persons of two spellings, "G" among them."""
    word, own, slips = "Lopimabargac", {}, {}
    for i, m in enumerate("ABCDEFGH"):
        own[m], slips[m] = f"Jovan {m}. {word}", f"Jovan {m}. {word[: i + 2] + word[i + 3 :]}"
    got = people(spark, OTHERS + [*own.values(), *slips.values()])
    mine = {p for p in got if set(p) & {*own.values(), *slips.values()}}
    assert mine == {tuple(sorted((own[m], slips[m]))) for m in own}


def test_families_are_settled_alike_within_a_task_and_by_joins(spark):
    random.seed(3)
    words = ["lopimabargac", "lopmabargac", "lopimabargc", "zopimabargac", "zopimabargaci", "torotasevin", "torotasevim"]
    rows = {(random.choice(words), random.choice(("jovan", "petar")), random.choice(("", "", "a", "b", "c"))) for _ in range(60)}
    support = {w: n for w, n in zip(words, (20, 1, 2, 9, 1, 1, 1), strict=True)}
    data = [(i * 37 % 101, w, f, m, support[w], 1 + i % 5) for i, (w, f, m) in enumerate(sorted(rows))]
    records = spark.createDataFrame(data, "pid bigint, surname string, full string, middle string, support bigint, n bigint")
    near = names.near_surnames(records.select("surname", "support").distinct(), 2)
    settled = [{(r["pid"], r["entity"]) for r in names.merged_profiles(records, near, 2, family).collect()} for family in (1, 2000)]
    assert settled[0] == settled[1] and 4 < len({e for _, e in settled[0]}) < len(data)


def test_words_one_edit_apart_share_a_key(spark):
    random.seed(5)
    pairs = []
    for n in (3, 4, 5, 31, 63, 64, 65, 66, 200):
        for _ in range(25):
            w = "".join(random.choice("abcd") for _ in range(n))
            i = random.randrange(n)
            for v in (w[:i] + w[i + 1 :], w[:i] + "e" + w[i:], w[:i] + "e" + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]):
                if min(len(v), n) >= 4 or n == 3 and len(v) == 4:
                    pairs.append((w, v))
    df = spark.createDataFrame(pairs, "w string, v string")
    w, v = F.col("w"), F.col("v")
    assert df.where(~F.arrays_overlap(names.deletions(w), names.deletions(v)) | ~names.one_edit(w, v)).count() == 0
    assert all(names._deletions(a) & names._deletions(b) and (a == b or names._one_edit(a, b)) for a, b in pairs)


def test_a_frequent_surname_brings_no_pairs_of_given_names(spark):
    """Short forms learned with the prefix filter are those that all pairs show."""
    random.seed(7)
    rows = {(f"s{i % 40}", random.choice(("slobodan", "boban", "dan", "petar", "pera"))) for i in range(400)} | {("hot", f"name{k}") for k in range(60)}
    rows |= {(f"r{i}", g) for i in range(12) for g in ("slobodan", "boban")} | {("hot", "slobodan"), ("hot", "boban")}
    parsed = spark.createDataFrame([(s, [g]) for s, g in sorted(rows)], "surname string, givens array<string>")
    listed = spark.createDataFrame([("pera", "petar")], "given string, full string")
    got = {(r["given"], r["full"]) for r in names.learn_short_forms(parsed, listed).collect()}
    by = {g: {s for s, h in rows if h == g} for _, g in rows}
    total = len({s for s, _ in rows})
    want = {("pera", "petar")}
    for g, a in by.items():
        for f, b in by.items():
            if g != f and len(a) <= len(b) and len(g) <= len(f):
                n, share = len(a & b), len(a & b) / len(a)
                alike = g[0] == f[0] or edit_distance(g, f, False) <= len(f) - 3
                if (alike and n >= 2 and share >= 0.3 and share * total / len(b) >= 4) or (n >= 5 and share >= 0.4 and share * total / len(b) >= 6):
                    want.add((g, f))
    assert {p for p in got if p[0] != p[1]} == want


def test_slip_is_judged_beside_the_other_spelling(spark):
    own = [form.format(g) for g in NAMES for form in ("{} Žumaljarganin", "Žumaljarganin, {}", "dr {} Žumaljarganin", "mr {} Žumaljarganin")]
    slips = [f"{g} Zuumaljarganin" for g in ("Jovan", "Petar", "Marko")]
    got = people(spark, OTHERS + own + slips)
    assert all(tuple(sorted((s, s.replace("Zuum", "Žum")))) in got for s in slips)


def test_degenerate_names(spark):
    assert people(spark, ["", " ", "-", "x"]) == set()
    long = "Ana " + "x" * 50_000
    assert people(spark, OTHERS + [long, long.upper()]) == {tuple(sorted((long, long.upper())))}
    empty = spark.createDataFrame([], "person_name string, received_by string")
    assert names.spellings(empty, ["person_name", "received_by"]).count() == 0


def test_units(spark):
    same = ["Sektor za informacione tehnologije", "SIT", "IT sektor", "Sekt. za inf. tehnologije", "sektor za infornacione tehnologije", "Informacione tehnologije - sektor"]
    towns = [f"{k} {t}{n}" for t in ("Selište", "Topolnik", "Jezerani") for k, n in (("Filijala", " 1"), ("Filijala", " 2"), ("Poslovnica", ""), ("Fil.", " 1"), ("Posl.", ""))]
    more = ["Sektor informacionih tehnologija", "Filijala br. 1 Selište", "Selište, poslovnica"]
    df = spark.createDataFrame([(s, 1) for s in same + towns + more + ["(naziv organizacione jedinice)"]], "raw string, n bigint")
    got = {(r["name_a"], r["name_b"]) for r in names.pairs_of(units.resolve_units(df, least_support=2), "unit").collect()}
    expected = both(*same, more[0])
    for t in ("Selište", "Topolnik", "Jezerani"):
        expected |= both(f"Filijala {t} 1", f"Fil. {t} 1", *([more[1]] if t == "Selište" else [])) | both(f"Poslovnica {t}", f"Posl. {t}", *([more[2]] if t == "Selište" else []))
    assert got == expected


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
