"""Variant spellings of names typed by people: merge-and-rematch resolution.

Every distinct string becomes a profile of spellings, given names and initials.
Profiles that match are merged, which unions what they know; the richer profiles
enter blocking again, until no merge is left. Strings that fit several persons
(an initial, an ambiguous short form) join finished profiles and never bridge two.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.folding import consistent, plain_latin
from gridloom.session import cut_lineage, release_past

# Titles and degrees, and what is written where no name is.
TITLES = set("dr mr prof inz ing dipl ecc ecc. mag spec doc msc phd gda gdin gdica g-da g-din g-dica gospoda gospodin gospodja".split())
NOT_A_NAME = re.compile(
    r"\b(?:prezime|naziv|necitko|necitak|necitljivo|nejasno|nepoznato|nepoznat|illegible|unreadable|potpis|bez imena|ne zna se|nema)\b"
)
#: What being on the list of given names weighs against frequency.
LISTED = 1e9

_WORD = re.compile(r"[a-z]+(?:[-'][a-z]+)*")


def simplified(raw: str) -> str:
    """Latin letters without accents in lower case; glued words apart; đ, dj and d alike."""
    return plain_latin(_camel(consistent(raw))).replace("dj", "d")


def _camel(text: str) -> str:
    out, low = [], 0
    for c in text:
        if c.isupper() and low >= 2:
            out.append(" ")
        low = low + 1 if c.islower() else 0
        out.append(c)
    return "".join(out)


def is_name(plain: str) -> bool:
    return sum(c.isalpha() for c in plain) > 1 and not NOT_A_NAME.search(plain)


def words_of(plain: str) -> tuple[list[str], list[str]]:
    """Full words without titles, and single letters (initials).

    "g" before two full words is a title, elsewhere an initial.
    """
    words = _WORD.findall(plain)
    if words[:1] == ["g"] and sum(len(w) > 2 and w not in TITLES for w in words) > 1:
        del words[0]
    words = [w for w in words if w not in TITLES]
    full = [w for w in words if len(w) > 2 or (len(w) == 2 and w not in ("lj", "nj", "dz"))]
    return full, [w[0] for w in words if w not in full]


class Known:
    """What the lexicon of given names says about the words of one string: rows of (word, name, weight)."""

    def __init__(self, rows: list[tuple[str, str, float]]) -> None:
        self.weight = {name: weight for _, name, weight in rows}
        self.exact = {word for word, name, _ in rows if word == name}
        self._near: dict[str, list[str]] = {}
        for word, name, _ in rows:
            self._near.setdefault(word, []).append(name)

    def near(self, word: str) -> list[str]:
        """The given names a word may be: itself if known, else those one edit away, the usual first."""
        if word in self.exact:
            return [word]
        return sorted(self._near.get(word, ()), key=lambda n: (-self.weight[n], n))


def parse(plain: str, known: Known) -> tuple[str, list[str], str, str]:
    """Surname, possible given names, initial of the given name, middle initial."""
    full, initials = words_of(plain)
    if not full:
        return "", [], "", ""
    if len(full) == 1 and not initials:
        full = _unglue(full[0], known)
    if len(full) == 1:
        return full[0], [], initials[0] if initials else "", initials[1] if len(initials) > 1 else ""
    exact = [w for w in full if w in known.exact]
    if len(exact) == 1:
        given = exact[0]
    elif exact:
        given = max(exact, key=lambda w: (known.weight[w], -full.index(w)))
    else:
        close = [w for w in full if known.near(w)]
        if close:
            given = max(close, key=lambda w: (known.weight[known.near(w)[0]], -len(w)))
        elif "," in plain and plain.index(",") < len(plain) - 3:
            given = full[-1]
        else:
            given = min(full, key=lambda w: (len(w), full.index(w)))
    rest = list(full)
    rest.remove(given)
    means = known.near(given) or [given]
    return "-".join(rest), means, means[0][0], initials[0] if initials else ""


def _unglue(word: str, known: Known) -> list[str]:
    """A given name and a surname written as one word, the longer given name first."""
    for k in range(len(word) - 4, 3, -1):
        if word[:k] in known.exact:
            return [word[:k], word[k:]]
    for k in range(4, len(word) - 3):
        if word[k:] in known.exact:
            return [word[k:], word[:k]]
    return [word]


def _simplified_pairs(given_names: DataFrame) -> DataFrame:
    """``given, full``: the short forms and names of the list, as names are compared."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"given": [simplified(x or "") for x in pdf["short_form"]], "full": [simplified(x or "") for x in pdf["given_name"]]})

    return given_names.select("given_name", "short_form").mapInPandas(fold, "given string, full string")


def given_name_lexicon(plain: DataFrame, listed: DataFrame) -> DataFrame:
    """``name, weight``: given names by their company, which is met by more words than its own company meets.

    Names of the list are always in and outweigh others. ``plain`` has the ``words`` of every string.
    """
    pair = plain.where("size(words) = 2 AND words[0] <> words[1]").select(
        F.inline(F.expr("array(struct(words[0] AS word, words[1] AS other), struct(words[1] AS word, words[0] AS other))"))
    )
    met = pair.distinct()
    degree = met.groupBy(F.col("word").alias("other")).agg(F.count(F.lit(1)).alias("other_deg"))
    score = met.join(degree, "other").groupBy("word").agg(F.count(F.lit(1)).alias("deg"), F.percentile_approx("other_deg", 0.75).alias("usual"))
    likely = score.where("deg >= 3 AND deg > usual").select(F.col("word").alias("name"), F.col("deg").cast("double").alias("weight"))
    given = listed.select(F.explode(F.array("given", "full")).alias("name"), F.lit(LISTED).alias("weight")).where("name <> ''")
    return likely.unionByName(given).groupBy("name").agg(F.sum("weight").alias("weight"))


def look_up(plain: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``plain`` with ``found``: what the lexicon knows about the words of each string.

    Known words by an equi-join, others by one edit through hashed deletion keys, each
    distinct word once. A word that stands alone may be two written as one, so its
    beginnings and ends, as long as some known name, are looked up too.
    """
    longest = lexicon.agg(F.max(F.length("name"))).first()[0] or 0
    word = F.element_at("words", 1)
    spans = F.transform(
        F.sequence(F.lit(4), F.greatest(F.lit(4), F.least(F.length(word) - 4, F.lit(longest)))),
        lambda k: F.array(F.substring(word, F.lit(1), k), F.substring(word, F.length(word) - k + 1, k)),
    )
    parts = F.when((F.size("words") == 1) & F.col("alone") & (F.length(word) >= 8), F.flatten(spans)).otherwise(F.array().cast("array<string>"))
    whole = F.transform("words", lambda w: F.named_struct(F.lit("word"), w, F.lit("fuzzy"), F.length(w) >= 4))
    cut = F.transform(parts, lambda w: F.named_struct(F.lit("word"), w, F.lit("fuzzy"), F.lit(False)))
    asked = plain.select("raw", F.inline(F.concat(whole, cut)))
    words = asked.groupBy("word").agg(F.max("fuzzy").alias("fuzzy"))
    exact = words.join(lexicon, words["word"] == lexicon["name"]).select("word", "name", "weight")
    rest = words.where("fuzzy").join(exact.select("word"), "word", "left_anti")
    near = (
        rest.select("word", F.explode(deletions(F.col("word"))).alias("key"))
        .join(lexicon.select("name", "weight", F.explode(deletions(F.col("name"))).alias("key")), "key")
        .where(one_edit(F.col("word"), F.col("name")))
        .select("word", "name", "weight")
        .distinct()
    )
    table = exact.unionByName(near)
    found = asked.select("raw", "word").distinct().join(table, "word").groupBy("raw").agg(F.collect_list(F.struct("word", "name", "weight")).alias("found"))
    return plain.join(found, "raw", "left")


def learn_short_forms(parsed: DataFrame, listed: DataFrame) -> DataFrame:
    """``given, full``: the full names a given name may stand for, itself included where it is one.

    Short forms of the list, and those the data show: a form whose surnames mostly
    also bear one certain other name, far more often than chance would have it.

    Only pairs that share 0.3 of the form's surnames, and two at least, can pass; so a
    form's most frequent surnames need not bring pairs together (a prefix filter, which
    loses no pair), and no frequent surname makes all pairs of its given names.
    """
    own = parsed.where("size(givens) = 1").select("surname", F.element_at("givens", 1).alias("given")).distinct()
    own = own.join(own.groupBy("surname").agg(F.count(F.lit(1)).alias("f")), "surname")
    blocks = own.groupBy("given").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("f", "surname"))["surname"].alias("top"), F.percentile_approx("f", 0.75, 10_000).alias("high")
    )
    total = own.agg(F.count_distinct("surname")).first()[0]
    # Of 21 surnames and more a quarter may go, else the most frequent one.
    keys = own.join(blocks.where("n > 1"), "given").where(F.when(F.col("n") > 20, F.col("f") <= F.col("high")).otherwise(F.col("surname") != F.col("top")))
    other = own.select("surname", F.col("given").alias("full")).join(blocks.select(F.col("given").alias("full"), F.col("n").alias("n_full")), "full")
    met = (
        keys.select("surname", "given", "n")
        .join(other, "surname")
        .where("given <> full AND n <= n_full AND length(given) <= length(full)")
        .select("given", "full", "n", "n_full")
        .distinct()
    )
    both = met.join(own.select("given", "surname"), "given").join(own.select(F.col("given").alias("full"), "surname"), ["full", "surname"])
    rated = (
        both.groupBy("given", "full", "n", "n_full")
        .agg(F.count(F.lit(1)).alias("both"))
        .withColumn("share", F.col("both") / F.col("n"))
        .withColumn("lift", F.col("share") * F.lit(max(total, 1)) / F.col("n_full"))
    )
    alike = (F.substring("given", 1, 1) == F.substring("full", 1, 1)) | (F.levenshtein("given", "full") <= F.length("full") - 3)
    shown = rated.where(
        (alike & (F.col("both") >= 2) & (F.col("share") >= 0.3) & (F.col("lift") >= 4))
        | ((F.col("both") >= 5) & (F.col("share") >= 0.4) & (F.col("lift") >= 6))
    )
    listed = listed.where("given <> '' AND full <> ''")
    # What the list says is enough for its short forms, unless the data show another name clearly.
    known = listed.select("given").distinct().withColumn("_listed", F.lit(True))
    clear = shown.join(known, "given", "left").where("_listed IS NULL OR (share >= 0.4 AND both >= 4)").select("given", "full")
    pairs = cut_lineage(listed.select("given", "full").unionByName(clear).distinct())
    # A name that is short for nothing stands for itself.
    alone = blocks.select("given").join(pairs.select("given").distinct(), "given", "left_anti").select("given", F.col("given").alias("full"))
    return pairs.unionByName(alone)


#: Letters at either end that tell long words apart: one edit cannot touch both ends of a word of twice as many.
END = 32


def deletions(word: Column) -> Column:
    """Hashes by which spellings one edit apart meet.

    From four letters on those of the word less each of its letters; of long words
    their two ends instead, one of which no single edit touches. Lengths at the border
    have both, so words on either side of it meet too.
    """
    n = F.length(word)
    cut = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(2 * END + 1))),
        lambda i: F.xxhash64(F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n))),
    )
    ends = F.array(F.xxhash64(F.lit("<"), F.substring(word, 1, END)), F.xxhash64(F.lit(">"), F.substring(word, n - END + 1, F.lit(END))))
    none = F.array().cast("array<bigint>")
    return F.array_distinct(
        F.concat(F.array(F.xxhash64(word)), F.when(n.between(4, 2 * END + 1), cut).otherwise(none), F.when(n >= 2 * END, ends).otherwise(none))
    )


def _deletions(word: str) -> set[str]:
    """The keys of :func:`deletions` as text."""
    keys = {word}
    if 4 <= len(word) <= 2 * END + 1:
        keys |= {word[:i] + word[i + 1 :] for i in range(len(word))}
    if len(word) >= 2 * END:
        keys |= {"<" + word[:END], ">" + word[-END:]}
    return keys


def one_edit(a: Column, b: Column) -> Column:
    """Equal, or one letter inserted, dropped, changed, or two neighbours exchanged."""
    n = F.length(a)
    i = F.length(F.regexp_extract(F.concat(a, F.lit("\n"), b), r"^(.*).*\n\1", 1))
    swapped = F.concat(F.substring(a, F.lit(1), i), F.substring(a, i + 2, F.lit(1)), F.substring(a, i + 1, F.lit(1)), F.substring(a, i + 3, n))
    return F.levenshtein(a, b, 1).between(0, 1) | ((n == F.length(b)) & (F.levenshtein(a, b, 2) == 2) & (swapped == b))


#: A spelling this many times rarer than another is a slip of it, however often it stands.
SLIP_RATIO = 4


def slip(a: Column, b: Column, rare: int) -> Column:
    """Whether one of two supports is so small, in itself or beside the other, that it may be a slip."""
    return (F.least(a, b) <= rare) | (F.least(a, b) * SLIP_RATIO <= F.greatest(a, b))


def near_surnames(support: DataFrame, rare: int) -> DataFrame:
    """``s, t``: surnames (with ``support``) that may be one, both ways round, and every surname with itself."""
    keyed = support.select("surname", "support", F.explode(deletions(F.col("surname"))).alias("key"))
    a = keyed.select(F.col("surname").alias("s"), F.col("support").alias("s_support"), "key")
    b = keyed.select(F.col("surname").alias("t"), F.col("support").alias("t_support"), "key")
    # A slip is rare, in itself or beside the other; two well supported spellings are two names.
    fits = (F.col("s") != F.col("t")) & slip(F.col("s_support"), F.col("t_support"), rare) & one_edit(F.col("s"), F.col("t"))
    return a.join(b, "key").where(fits).select("s", "t").distinct().unionByName(support.select(F.col("surname").alias("s"), F.col("surname").alias("t")))


def _merge_round(profiles: DataFrame, near: DataFrame) -> DataFrame:
    """Edges ``a, b`` that link all profiles that match now.

    Profiles of one full name, surname and middle initial all match each other, so each
    is joined to one hub only, and hubs of near surnames and agreeing initials to each
    other: every matching pair is linked, by fewer edges than there are pairs.
    """
    spelled = profiles.select("pid", "middle", "full", F.explode("spellings").alias("surname"))
    hubs = spelled.groupBy("full", "surname", "middle").agg(F.min("pid").alias("hub"))
    own = spelled.join(hubs, ["full", "surname", "middle"]).where("pid <> hub").select(F.col("pid").alias("a"), F.col("hub").alias("b"))
    one = hubs.select("full", F.col("surname").alias("s"), F.col("middle").alias("ma"), F.col("hub").alias("a"))
    other = hubs.select("full", F.col("surname").alias("t"), F.col("middle").alias("mb"), F.col("hub").alias("b"))
    agree = (F.col("ma") == "") | (F.col("mb") == "") | (F.col("ma") == F.col("mb"))
    across = one.join(near, "s").join(other, ["full", "t"]).where(agree & (F.col("a") < F.col("b"))).select("a", "b")
    # Counted, because a plain distinct over this union cannot be checkpointed (Spark loses a column).
    return own.unionByName(across).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _settled(rows: list[tuple[int, str, str, int, int]], rare: int) -> dict[int, int]:
    """Merge and rematch within one family: profile -> entity (rows of pid, surname, middle, support, n).

    The rounds of :func:`_merge_round` and :func:`_agreeing` for profiles of one full name.
    """
    support = {r[1]: r[3] for r in rows}
    by_key: dict[str, list[str]] = {}
    for w in support:
        for key in _deletions(w):
            by_key.setdefault(key, []).append(w)
    near: dict[str, set[str]] = {w: {w} for w in support}
    for group in by_key.values():
        for s, t in itertools.combinations(group, 2):
            x, y = support[s], support[t]
            if (min(x, y) <= rare or min(x, y) * SLIP_RATIO <= max(x, y)) and _one_edit(s, t):
                near[s].add(t)
                near[t].add(s)
    entity = {r[0]: r[0] for r in rows}
    while True:
        middle: dict[int, str] = {}
        weight: dict[int, int] = {}
        spelled: dict[int, set[str]] = {}
        for pid, surname, mid, _, n in rows:
            e = entity[pid]
            middle[e] = max(mid, middle.get(e, ""))
            weight[e] = weight.get(e, 0) + n
            spelled.setdefault(e, set()).add(surname)
        hubs: dict[tuple[str, str], int] = {}
        for e, spellings in spelled.items():
            for w in spellings:
                hubs[w, middle[e]] = min(e, hubs.get((w, middle[e]), e))
        edges = {(e, hubs[w, middle[e]]) for e, spellings in spelled.items() for w in spellings if hubs[w, middle[e]] != e}
        middles = sorted(set(middle.values()))
        for (s, ma), x in hubs.items():
            for t in near[s]:
                for mb in middles if ma == "" else ("", ma):
                    y = hubs.get((t, mb))
                    if y is not None and x < y:
                        edges.add((x, y))
        if not edges:
            return entity
        likely: dict[int, tuple[int, int, str]] = {}
        for x, y in edges:
            for p, q in ((x, y), (y, x)):
                if middle[q]:
                    likely[p] = max(likely.get(p, (-1, -1 << 63, "")), (weight[q], q, middle[q]))
        stands = {e: m or likely.get(e, (0, 0, ""))[2] for e, m in middle.items()}
        root = {e: e for e in middle}

        def top(e: int, root: dict[int, int] = root) -> int:
            while root[e] != e:
                root[e] = e = root[root[e]]
            return e

        for x, y in edges:
            if stands[x] == stands[y]:
                x, y = sorted((top(x), top(y)))
                root[y] = x
        entity = {pid: top(e) for pid, e in entity.items()}


def _one_edit(s: str, t: str) -> bool:
    if abs(len(s) - len(t)) > 1:
        return False
    i = len(os.path.commonprefix((s, t)))
    rest = (s[i + 1 :], t[i + 1 :]), (s[i:], t[i + 1 :]), (s[i + 1 :], t[i:])
    return any(x == y for x, y in rest) or (s[i : i + 2] == t[i : i + 2][::-1] and s[i + 2 :] == t[i + 2 :])


def merged_profiles(records: DataFrame, near: DataFrame, rare: int, family: int = 2000) -> DataFrame:
    """``pid, entity``: merge and rematch until no two profiles match.

    Only profiles of one full name whose surnames are linked by slips can ever meet:
    such families are found once, and one of at most ``family`` profiles is settled
    within a task. Larger ones go through the same rounds as joins.
    """
    nodes = records.select("full", "surname").distinct().withColumn("node", F.xxhash64("full", "surname"))
    one = nodes.select("full", F.col("surname").alias("s"), F.col("node").alias("a"))
    links = one.join(near.where("s < t"), "s").join(nodes.select("full", F.col("surname").alias("t"), F.col("node").alias("b")), ["full", "t"]).select("a", "b")
    roots = components(links)
    placed = records.withColumn("node", F.xxhash64("full", "surname")).join(roots, "node", "left").withColumn("family", F.coalesce("root", "node"))
    sizes = placed.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    placed = cut_lineage(placed.join(sizes, "family").select("family", "size", *records.columns))
    alone = placed.where("size = 1").select("pid", F.col("pid").alias("entity"))
    member = F.struct("pid", "surname", "middle", "support", "n")
    small = placed.where(F.col("size").between(2, family)).groupBy("family").agg(F.collect_list(member).alias("rows"))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [pair for rows in pdf["rows"] for pair in _settled([tuple(r[c] for c in ("pid", "surname", "middle", "support", "n")) for r in rows], rare).items()]
            yield pd.DataFrame(out, columns=["pid", "entity"])

    done = alone.unionByName(small.select("rows").mapInPandas(settle, "pid bigint, entity bigint"))
    large = placed.where(F.col("size") > family).select(*records.columns)
    return done.unionByName(_merged_by_joins(large, near)) if large.limit(1).count() else done


def _merged_by_joins(records: DataFrame, near: DataFrame) -> DataFrame:
    """Merge and rematch by joins over all profiles, a round at a time."""
    member = records.select("pid", F.col("pid").alias("entity"))
    while True:  # a round merges at least two profiles
        profiles = (
            records.join(member, "pid")
            .groupBy("entity")
            .agg(
                F.min("full").alias("full"), F.max("middle").alias("middle"),
                F.collect_set("surname").alias("spellings"), F.sum("n").alias("weight"),
            )
            .withColumnRenamed("entity", "pid")
        )
        edges = cut_lineage(_merge_round(profiles, near)).select("a", "b")
        if not edges.limit(1).count():
            return member
        roots = components(_agreeing(edges, profiles))
        member = cut_lineage(
            member.join(roots, member["entity"] == roots["node"], "left").select("pid", F.coalesce("root", "entity").alias("entity"))
        )


def resolve_people(
    strings: DataFrame, given_names: DataFrame, together: DataFrame | None = None, rare: int = 2
) -> DataFrame:
    """``entity, raw``: which strings may be written for one person.

    ``strings`` has distinct ``raw`` with ``n``; ``together`` optionally pairs strings
    (``raw_a, raw_b``) that context puts on one person, used only to choose between
    persons that fit a string anyway. A string may belong to several entities only
    where context says so.

    Null, empty and blank strings, dashes, captions and remarks that a value cannot be
    read are no names and belong to no entity. Repeated rows are one string; ties
    between persons go to the one written most, then to the smaller key; an empty
    table gives no rows.

    Scale: everything after the first aggregation is per distinct string, and what is
    compared by edits per distinct word or surname, by hashes of spellings less a
    letter. The lexicon of given names and the short forms are tables, joined. A
    string without a full given name meets one candidate a surname, initial and middle
    initial, however many persons bear the surname.
    """

    def simplify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            plain = [simplified(r) for r in pdf["raw"]]
            parts = [words_of(p) for p in plain]
            keep = [is_name(p) for p in plain]
            yield pd.DataFrame({"raw": pdf["raw"], "n": pdf["n"], "plain": plain, "words": [f for f, _ in parts], "alone": [not i for _, i in parts]})[keep]

    plain = cut_lineage(strings.select("raw", "n").mapInPandas(simplify, "raw string, n bigint, plain string, words array<string>, alone boolean"))
    listed = cut_lineage(_simplified_pairs(given_names))
    lexicon = cut_lineage(given_name_lexicon(plain, listed))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                parse(p, Known([] if f is None else [(x["word"], x["name"], x["weight"]) for x in f])) for p, f in zip(pdf["plain"], pdf["found"], strict=True)
            ]
            parts = pd.DataFrame(rows, columns=["surname", "givens", "initial", "middle"], index=pdf.index)
            yield pd.concat([pdf[["raw", "n", "plain"]], parts], axis=1)

    parsed = cut_lineage(
        look_up(plain, lexicon)
        .select("raw", "n", "plain", "found")
        .mapInPandas(read, "raw string, n bigint, plain string, surname string, givens array<string>, initial string, middle string")
        .where("surname <> ''")
    )
    forms = cut_lineage(learn_short_forms(parsed, listed))
    # One writing in several disguises supports its surname once.
    support = parsed.groupBy("surname").agg(F.count_distinct("plain").alias("support"))
    parsed = parsed.drop("plain")
    meant = (
        parsed.select("raw", F.explode("givens").alias("given")).join(forms, "given").groupBy("raw").agg(F.array_sort(F.collect_set("full")).alias("fulls"))
    )
    named = cut_lineage(parsed.join(support, "surname").join(meant, "raw", "left").withColumn("pid", F.xxhash64("surname", F.element_at("fulls", 1), "middle")))
    release_past(strings.sparkSession)
    clear = named.where(F.size("fulls") == 1).withColumn("full", F.element_at("fulls", 1))
    records = cut_lineage(clear.groupBy("pid", "surname", "full", "middle").agg(F.max("support").alias("support"), F.sum("n").alias("n")))
    near = cut_lineage(near_surnames(named.select("surname", "support").distinct(), rare))
    member = cut_lineage(merged_profiles(records, near, rare))
    known = cut_lineage(clear.join(member, "pid").select("entity", "raw", "surname", "initial", "middle", "full", "n"))
    release_past(strings.sparkSession)
    loose = named.where("fulls IS NULL OR size(fulls) > 1").withColumn("fulls", F.coalesce("fulls", F.array().cast("array<string>")))
    attached = cut_lineage(_attach(loose, known, forms, near, together))
    free = loose.join(attached.select("raw").distinct(), "raw", "left_anti").select(
        F.xxhash64("surname", "initial", F.lit("loose")).alias("entity"), "raw"
    )
    return known.select("entity", "raw").unionByName(attached).unionByName(free).distinct()


def _agreeing(edges: DataFrame, profiles: DataFrame) -> DataFrame:
    """Edges that cannot join profiles with different middle initials, not even by a chain.

    A profile without a middle initial takes that of its neighbour written most, and
    keeps the edges to profiles of that initial. One that has no such neighbour waits
    for those it meets to have theirs. Some edge is always kept.
    """
    about = profiles.select(F.col("pid").alias("b"), F.col("middle").alias("mb"), "weight")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    likely = both.join(about, "b").where("mb <> ''").groupBy("a").agg(F.max_by("mb", F.struct("weight", "b")).alias("likely"))
    settled = profiles.select(F.col("pid").alias("a"), "middle").join(likely, "a", "left").select(
        "a", F.when(F.col("middle") != "", F.col("middle")).otherwise(F.coalesce("likely", F.lit(""))).alias("ma")
    )
    return edges.join(settled, "a").join(settled.select(F.col("a").alias("b"), F.col("ma").alias("mb")), "b").where("ma = mb").select("a", "b")


def _attach(loose: DataFrame, known: DataFrame, forms: DataFrame, near: DataFrame, together: DataFrame | None) -> DataFrame:
    """Initials and ambiguous short forms joined to the person they fit best.

    An initial fits a person written with it so far, and less well one whose name has
    a short form that begins with it. What a string may ask for is written as tokens:
    an initial, or a full name it may mean. Of each surname, token and middle initial
    only the best person is kept before strings meet them.
    """
    facts = known.groupBy("entity").agg(
        F.collect_set("initial").alias("initials"),
        F.collect_set("full").alias("e_fulls"),
        F.array_remove(F.collect_set("middle"), "").alias("middles"),
        F.collect_set("surname").alias("surnames"),
        F.sum("n").alias("weight"),
    )
    short = forms.groupBy("full").agg(F.collect_set(F.substring("given", 1, 1)).alias("short_initials"))
    possible = (
        known.select("entity", "full").distinct().join(short, "full").groupBy("entity").agg(F.array_distinct(F.flatten(F.collect_list("short_initials"))).alias("possible"))
    )
    persons = cut_lineage(facts.join(possible, "entity", "left").withColumn("possible", F.coalesce("possible", F.array().cast("array<string>"))))
    token = lambda kind, what, written: F.named_struct(F.lit("token"), F.concat(F.lit(kind), what), F.lit("written"), F.lit(written))
    joined = lambda full: F.transform("initials", lambda i: token("f", F.concat(full, F.lit("|"), i), 1))
    tokens = F.concat(
        F.array(token("i", F.lit(""), 1)), F.transform("initials", lambda i: token("i", i, 1)), F.transform("possible", lambda i: token("i", i, 0)),
        F.flatten(F.transform("e_fulls", joined)), F.transform("e_fulls", lambda full: token("f", full, 0)),
    )
    slots = F.concat(F.array(F.lit("any")), F.when(F.size("middles") == 0, F.array(F.lit("none"))).otherwise(F.col("middles")))
    offered = persons.select("entity", "weight", F.explode("surnames").alias("t"), tokens.alias("tokens"), slots.alias("slots"))
    offered = offered.select("entity", "weight", "t", "tokens", F.explode("slots").alias("slot")).select("entity", "weight", "t", "slot", F.inline("tokens"))
    best = offered.groupBy("t", "token", "slot").agg(F.max(F.struct("written", "weight", (-F.col("entity")).alias("key"))).alias("best"))
    asks = F.when(F.size("fulls") == 0, F.array(F.concat(F.lit("i"), F.col("initial")))).otherwise(
        F.concat(F.transform("fulls", lambda f: F.concat(F.lit("f"), f, F.lit("|"), F.col("initial"))), F.transform("fulls", lambda f: F.concat(F.lit("f"), f)))
    )
    fit = F.when(F.col("middle") == "", F.array(F.lit("any"))).otherwise(F.array(F.lit("none"), F.col("middle")))
    # Strings that ask the same are asked once.
    kinds = loose.select("surname", "initial", "middle", "fulls").distinct().withColumn("ask", F.xxhash64("surname", "initial", "middle", "fulls"))
    asked = kinds.select("ask", "surname", F.explode(asks).alias("token"), fit.alias("slots")).select("ask", F.col("surname").alias("s"), "token", F.explode("slots").alias("slot"))
    found = (
        asked.join(near, "s")
        .join(best, ["t", "token", "slot"])
        .groupBy("ask")
        .agg(F.max(F.struct((F.col("s") == F.col("t")).cast("int").alias("same"), "best"))["best"]["key"].alias("key"))
        .select("ask", (-F.col("key")).alias("entity"))
    )
    loose = loose.withColumn("ask", F.xxhash64("surname", "initial", "middle", "fulls"))
    usual = loose.select("raw", "ask").join(found, "ask").select("entity", "raw")
    if together is None:
        return usual
    linked = together.join(known.select(F.col("raw").alias("raw_b"), "entity"), "raw_b").select(F.col("raw_a").alias("raw"), "entity").distinct()
    fits = (
        linked.join(loose.select("raw", F.col("surname").alias("s"), "initial", "middle", "fulls"), "raw")
        .join(persons, "entity")
        .where(
            F.when(F.size("fulls") > 0, F.arrays_overlap("fulls", "e_fulls")).otherwise(
                (F.col("initial") == "") | F.array_contains("initials", F.col("initial")) | F.array_contains("possible", F.col("initial"))
            )
            & ((F.col("middle") == "") | (F.size("middles") == 0) | F.array_contains("middles", F.col("middle")))
        )
        .select("raw", "entity", "s", F.explode("surnames").alias("t"))
        .join(near, ["s", "t"], "left_semi")
        .select("entity", "raw")
        .distinct()
    )
    return usual.join(fits.select("raw").distinct(), "raw", "left_anti").select("entity", "raw").unionByName(fits)


def pairs_of(members: DataFrame, kind: str) -> DataFrame:
    """Each unordered pair of strings of an entity once."""
    a = members.select("entity", F.col("raw").alias("name_a"))
    b = members.select("entity", F.col("raw").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select(F.lit(kind).alias("name_kind"), "name_a", "name_b").distinct()


def spellings(df: DataFrame, fields: list[str]) -> DataFrame:
    """Distinct strings of some columns with their numbers of occurrences; combined before the shuffle."""
    one = df.select(F.explode(F.array(*(F.col(f"`{f}`") for f in fields))).alias("raw")).where(F.col("raw").rlike(r"\p{L}"))
    return one.groupBy("raw").agg(F.count(F.lit(1)).alias("n"))


def seen_together(forms: DataFrame) -> DataFrame:
    """Pairs of strings that a form puts on one person: who is named and who received, and names under one identifier.

    Under an identifier every string is paired with one of them, the smallest, and that one with every other.
    """
    same_form = forms.select(F.col("person_name").alias("raw_a"), F.col("received_by").alias("raw_b"))
    named = forms.where("person_identifier <> '' AND person_name IS NOT NULL").select("person_identifier", F.col("person_name").alias("raw")).distinct()
    head = named.groupBy("person_identifier").agg(F.min("raw").alias("head"))
    under_one = named.join(head, "person_identifier").select(F.col("raw").alias("raw_a"), F.col("head").alias("raw_b"))
    pairs = same_form.unionByName(under_one).where("raw_a <> raw_b")
    return pairs.unionByName(pairs.select(F.col("raw_b").alias("raw_a"), F.col("raw_a").alias("raw_b"))).distinct()
