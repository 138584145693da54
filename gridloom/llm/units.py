"""Variant spellings of organisation names.

The same resolution as for persons over word profiles: words are corrected to well
supported ones, abbreviations and acronyms are expanded from what the column itself
shows, and profiles with one kind of unit and agreeing content and numbers are merged
until none is left. Every list that grows with the data is a table and is joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.fuzzytrie import edit_distance
from gridloom.llm.names import END, deletions, is_name, one_edit, simplified
from gridloom.session import cut_lineage, release_past

# Words without content, kinds of unit by the beginning of the word, and international acronyms.
STOP_WORDS = set("za i u mestu broj br na od o sa the of and".split())
KINDS = ("filij", "poslovn", "odel", "sekto", "sluzb", "cent", "odsek", "kabin", "labor", "direkc", "uprav", "ispost", "ekspoz")
GENERAL_KINDS = ("poslov",)
ACRONYMS = {"hr": ("ljudske", "resurse")}

_TOKEN = re.compile(r"([a-z]+)(\.?)|(\d+)")

#: A word as read: itself, whether a point follows, the words it may mean with their weights and stems, the usual first.
Token = dict


def kind_of(word: str) -> str | None:
    """The kind of unit a word names: '' for one that fits every kind, None for content."""
    for k in KINDS:
        if word.startswith(k):
            return k
    return "" if word.startswith(GENERAL_KINDS) else None


def tokens_of(plain: str) -> tuple[list[tuple[str, bool]], list[str]]:
    """Words with whether a point follows, without stop words; and numbers."""
    words: list[tuple[str, bool]] = []
    numbers = []
    for word, point, number in _TOKEN.findall(plain):
        if number:
            numbers.append(number.lstrip("0") or "0")
        elif word in ACRONYMS:
            words += [(w, False) for w in ACRONYMS[word]]
        elif word not in STOP_WORDS:
            words.append((word, bool(point)))
    return words, sorted(numbers)


def shared_beginnings(word):
    """What a word may share with its other endings: beginnings of three letters and 0.6 of it at least, but for three letters."""
    n = F.length(word)
    return F.transform(F.sequence(F.least(n, F.greatest(F.lit(3), F.ceil(n * 0.6).cast("int"), n - 3)), n), lambda k: F.substring(word, F.lit(1), k))


def well_supported(words: DataFrame, least: int) -> DataFrame:
    """``to, weight``: words of four letters and more in at least ``least`` strings, less the slips of others.

    A word one edit from a ten times better supported one is a slip of it, unless only its ending differs.
    """
    known = cut_lineage(words.where(~F.col("point") & (F.length("word") >= 4) & (F.col("n") >= least)).select(F.col("word").alias("to"), F.col("n").alias("weight")))
    keyed = known.select("to", "weight", F.explode(deletions(F.col("to"))).alias("key"))
    other = keyed.select(F.col("to").alias("better"), F.col("weight").alias("more"), "key")
    endings = F.arrays_overlap(shared_beginnings(F.col("to")), shared_beginnings(F.col("better")))
    slips = keyed.join(other, "key").where((F.col("more") >= 10 * F.col("weight")) & one_edit(F.col("to"), F.col("better")) & ~endings)
    return known.join(slips.select("to").distinct(), "to", "left_anti")


def two_deletions(word):
    """Keys by which words two edits apart meet: less one and two letters from eight letters on, up to ``2 * END``."""
    n = F.length(word)
    less = lambda w, i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))
    once = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(2 * END))), lambda i: less(word, i))
    twice = F.flatten(F.transform(once, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.xxhash64(less(w, i)))))
    more = F.when(n.between(7, 2 * END), F.concat(F.transform(once, lambda w: F.xxhash64(w)), twice)).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(deletions(word), more))


def meanings(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``word, point, to, weight``: the well supported words each word may mean.

    A known word means itself; one with a point, all it may be the beginning of; others
    the nearest, at one edit from four letters on, at two from eight to 64.
    """
    exact = words.join(lexicon, words["word"] == lexicon["to"]).select("word", "point", "to", "weight")
    rest = words.join(lexicon.select(F.col("to").alias("word")), "word", "left_anti").select("word", "point")
    begins = lexicon.where("length(to) > 2").select("to", "weight", F.explode(F.expr("transform(sequence(1, length(to) - 2), k -> substring(to, 1, k))")).alias("word"))
    short = cut_lineage(rest.where("point").join(begins, "word").select("word", "point", "to", "weight"))
    far = rest.join(short.select("word", "point").distinct(), ["word", "point"], "left_anti").where("length(word) >= 4")
    met = (
        far.select("word", "point", F.explode(two_deletions(F.col("word"))).alias("key"))
        .join(lexicon.select("to", "weight", F.explode(two_deletions(F.col("to"))).alias("key")), "key")
        .select("word", "point", "to", "weight")
        .distinct()
    )

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(edits=[_edits(a, b) for a, b in zip(pdf["word"], pdf["to"], strict=True)])

    near = met.mapInPandas(measure, "word string, point boolean, to string, weight bigint, edits int")
    best = near.where("edits = 1 OR (edits = 2 AND length(word) >= 8)").groupBy("word", "point").agg(
        F.max(F.struct((-F.col("edits")).alias("e"), "weight", "to")).alias("b")
    )
    return exact.unionByName(short).unionByName(best.select("word", "point", "b.to", "b.weight"))


def _edits(a: str, b: str) -> int:
    """Edits between two words that are near; 9 if far."""
    if abs(len(a) - len(b)) > 2:
        return 9
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    # What differs, with a letter on either side for letters exchanged at the border.
    a, b = a[max(0, i - 1) : len(a) - max(0, j - 1)], b[max(0, i - 1) : len(b) - max(0, j - 1)]
    return 9 if max(len(a), len(b)) > 2 * END else edit_distance(a, b, digits_exact=False)


def stems(words: DataFrame) -> DataFrame:
    """``word, stem``: the best supported word that differs in its ending only (``word, n`` in)."""
    keyed = words.select("word", "n", F.explode(shared_beginnings(F.col("word"))).alias("key"))
    head = keyed.groupBy("key").agg(F.max(F.struct("n", "word")).alias("head"))
    own = keyed.join(head, "key").groupBy("word").agg(F.max("head")["word"].alias("up"))
    # The head may itself have a better one.
    return own.join(own.select(F.col("word").alias("up"), F.col("up").alias("top")), "up").select("word", F.col("top").alias("stem"))


def reading(tokens: Sequence[Token], acronyms: dict[str, list[tuple[str, str]]]) -> list[list[tuple[str, str]]]:
    """The tokens as slots of (word, stem): what each may be, several only where its stem is in doubt."""
    out: list[list[tuple[str, str]]] = []
    for t in tokens:
        options = list({o["stem"]: (o["to"], o["stem"]) for o in reversed(t["options"] if t["options"] is not None else [])}.values())[::-1]
        if options:
            out.append(options)
        elif t["word"] in acronyms:
            out += [[pair] for pair in acronyms[t["word"]]]
        else:
            out.append([(t["word"], t["stem"] or t["word"])])
    return out


def profile(words: Sequence[tuple[str, str]]) -> tuple[str, list[str]]:
    """Kind of unit and content of words with their stems."""
    kinds = [k for w, _ in words if (k := kind_of(w))]
    return (kinds[0] if kinds else ""), sorted({stem for w, stem in words if kind_of(w) is None})


def completed(slots: list[list[tuple[str, str]]], content: Sequence[str]) -> list[tuple[str, str]] | None:
    """One word for each slot so that the content is ``content``; None if there is no such choice."""
    wanted = set(content)
    fit = [[o for o in s if kind_of(o[0]) is not None or o[1] in wanted] for s in slots]
    if not all(fit):
        return None
    taken: dict[str, int] = {}

    def place(stem: str, seen: set[int]) -> bool:
        for i, options in enumerate(fit):
            if i not in seen and any(o[1] == stem and kind_of(o[0]) is None for o in options):
                seen.add(i)
                holder = next((x for x, k in taken.items() if k == i), None)
                if holder is None or place(holder, seen):
                    taken[stem] = i
                    return True
        return False

    # Every wanted stem needs a slot of its own; the other slots repeat one.
    if not all(place(stem, set()) for stem in sorted(wanted)):
        return None
    by_slot = {i: stem for stem, i in taken.items()}
    return [next(o for o in options if o[1] == by_slot.get(i, o[1])) for i, options in enumerate(fit)]


_TOKENS = "tokens array<struct<pos:int,word:string,point:boolean>>"


def resolve_units(strings: DataFrame, least_support: int = 3) -> DataFrame:
    """``entity, raw``: which strings name one unit (columns ``raw`` distinct, ``n``).

    Null, empty and blank strings, captions and remarks are no units. Ties between
    units go to the better supported one, then to the smaller key; an empty table gives
    no rows.

    Scale: corrections, abbreviations, endings and acronyms are found once for each
    distinct word and joined back; an abbreviation in doubt is settled by the contents
    that other strings spell out, found by a join on what they share.
    """

    def simplify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            plain = [(r, simplified(r)) for r in pdf["raw"]]
            rows = [(r, *tokens_of(p)) for r, p in plain if is_name(p)]
            yield pd.DataFrame(
                [(r, [{"pos": i, "word": w, "point": p} for i, (w, p) in enumerate(words)], numbers) for r, words, numbers in rows], columns=["raw", "tokens", "numbers"]
            )

    plain = cut_lineage(strings.select("raw").mapInPandas(simplify, f"raw string, {_TOKENS}, numbers array<string>"))
    asked = plain.select("raw", F.inline("tokens"))
    words = cut_lineage(asked.groupBy("word", "point").agg(F.count_distinct("raw").alias("n")))
    lexicon = cut_lineage(well_supported(words, least_support))
    meant = cut_lineage(meanings(words, lexicon))
    unknown = words.join(meant.select("word", "point").distinct(), ["word", "point"], "left_anti")
    vocabulary = lexicon.select(F.col("to").alias("word"), F.col("weight").alias("n")).unionByName(unknown.groupBy("word").agg(F.sum("n").alias("n")))
    stem = cut_lineage(stems(vocabulary.groupBy("word").agg(F.max("n").alias("n"))))
    options = (
        meant.join(stem.select(F.col("word").alias("to"), "stem"), "to")
        .groupBy("word", "point")
        .agg(F.sort_array(F.collect_list(F.struct("weight", "to", "stem")), asc=False).alias("o"))
        .select("word", "point", F.transform("o", lambda o: F.struct(o["to"].alias("to"), o["stem"].alias("stem"))).alias("options"))
    )
    read = cut_lineage(
        asked.join(options, ["word", "point"], "left").join(stem, "word", "left")
        .groupBy("raw")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "word", "point", "stem", "options"))).alias("tokens"))
    )
    acronyms = expanded(read, unknown.where("NOT point AND length(word) >= 2").select("word").distinct())
    mine = (
        read.select("raw", F.explode("tokens").alias("t")).where("t.options IS NULL").select("raw", F.col("t.word").alias("word"))
        .distinct().join(acronyms, "word").groupBy("raw").agg(F.collect_list(F.struct("word", "run")).alias("acronyms"))
    )

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for raw, tokens, short in zip(pdf["raw"], pdf["tokens"], pdf["acronyms"], strict=True):
                known = {a["word"]: [(x["to"], x["stem"]) for x in a["run"]] for a in (short if short is not None else [])}
                ways = reading(tokens, known)
                kind, content = profile([w[0] for w in ways])
                doubt = any(len(w) > 1 for w in ways)
                out.append((raw, kind, content, doubt, [{"options": [{"to": a, "stem": b} for a, b in w]} for w in ways] if doubt else []))
            yield pd.DataFrame(out, columns=["raw", "kind", "content", "doubt", "slots"])

    first = cut_lineage(
        read.join(mine, "raw", "left").mapInPandas(slots, "raw string, kind string, content array<string>, doubt boolean, slots array<struct<options:array<struct<to:string,stem:string>>>>")
    )
    keyed = settled(first).join(plain.select("raw", "numbers"), "raw")
    keyed = cut_lineage(keyed.withColumn("pid", F.xxhash64("kind", "content", "numbers")))
    profiles = keyed.groupBy("pid", "kind", "content", "numbers").agg(F.count(F.lit(1)).alias("support"))
    member = cut_lineage(profiles.select("pid", "kind", "content", "numbers", "support", F.col("pid").alias("entity")))
    while True:  # a round merges at least two units
        edges = cut_lineage(_merge_round(member))
        if not edges.limit(1).count():
            break
        roots = components(edges)
        merged = member.join(roots, member["entity"] == roots["node"], "left").withColumn("entity", F.coalesce("root", "entity"))
        # Merged profiles know every kind and word of their members.
        whole = merged.groupBy("entity").agg(
            F.max("kind").alias("kind"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("content")))).alias("content"),
            F.first("numbers").alias("numbers"), F.sum("support").alias("support"),
        )
        member = cut_lineage(merged.select("pid", "entity").join(whole, "entity").select("pid", "kind", "content", "numbers", "support", "entity"))
    release_past(strings.sparkSession)
    return keyed.select("pid", "raw").join(member.select("pid", "entity"), "pid").select("entity", "raw")


def expanded(read: DataFrame, short: DataFrame) -> DataFrame:
    """``word, run``: for words nobody knows, the run of words with these initials that most strings spell out."""
    longest = short.agg(F.max(F.length("word"))).first()[0] or 0

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for tokens in pdf["tokens"]:
                if any(t["options"] is None and not t["point"] and len(t["word"]) <= 5 for t in tokens):
                    continue  # holds a short unknown word itself
                words = [w[0] for w in reading(tokens, {})]
                for i in range(len(words)):
                    for j in range(i + 2, min(len(words), i + longest) + 1):
                        run = words[i:j]
                        for initials in {"".join(w[0] for w, _ in run), "".join("lj" if w.startswith("lj") else w[0] for w, _ in run)}:
                            out.append((initials, [{"to": a, "stem": b} for a, b in run]))
            yield pd.DataFrame(out, columns=["word", "run"])

    spelled = read.select("tokens").mapInPandas(runs, "word string, run array<struct<to:string,stem:string>>")
    return spelled.join(short, "word", "left_semi").groupBy("word", "run").agg(F.count(F.lit(1)).alias("n")).groupBy("word").agg(F.max_by("run", F.struct("n", "run")).alias("run"))


def settled(first: DataFrame) -> DataFrame:
    """``raw, kind, content``: abbreviations in doubt completed to the content that most strings spell out, else as usual."""
    sure = first.where("NOT doubt").select("raw", "kind", "content")
    doubtful = first.where("doubt")
    known = sure.where("size(content) > 0").groupBy("content").agg(F.count(F.lit(1)).alias("n"))
    inside = F.explode(F.array_distinct(F.transform(F.flatten("slots.options"), lambda o: o["stem"]))).alias("stem")
    met = (
        doubtful.select("raw", inside)
        .join(known.select("content", "n", F.element_at("content", 1).alias("stem")), "stem")
        .groupBy("raw")
        .agg(F.collect_list(F.struct("n", F.col("content").alias("known"))).alias("contents"))
    )

    def complete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for raw, kind, content, slots, contents in zip(pdf["raw"], pdf["kind"], pdf["content"], pdf["slots"], pdf["contents"], strict=True):
                ways = [[(o["to"], o["stem"]) for o in s["options"]] for s in slots]
                rated = sorted(contents if contents is not None else [], key=lambda c: (-c["n"], list(c["known"])))
                words = next((w for c in rated if (w := completed(ways, list(c["known"]))) is not None), None)
                out.append((raw, *profile(words)) if words else (raw, kind, content))
            yield pd.DataFrame(out, columns=["raw", "kind", "content"])

    return sure.unionByName(doubtful.join(met, "raw", "left").mapInPandas(complete, "raw string, kind string, content array<string>"))


def _merge_round(member: DataFrame) -> DataFrame:
    """Each profile with the best supported one that contains it: same numbers, kinds that agree.

    Profiles meet on the rarest word of the smaller one, which the larger must have.
    """
    p = member.groupBy("entity").agg(
        F.max("kind").alias("kind"), F.first("content").alias("content"), F.first("numbers").alias("numbers"), F.max("support").alias("support")
    )
    large = p.select(
        F.col("entity").alias("other"), F.col("kind").alias("o_kind"), F.col("content").alias("o_content"), "numbers",
        F.col("support").alias("o_support"), F.explode("content").alias("word"),
    )
    common = large.groupBy("numbers", "word").agg(F.count(F.lit(1)).alias("n"))
    rarest = p.select("entity", "numbers", F.explode("content").alias("word")).join(common, ["numbers", "word"]).groupBy("entity").agg(F.min(F.struct("n", "word"))["word"].alias("word"))
    fits = p.join(rarest, "entity").join(large, ["numbers", "word"]).where(
        "entity <> other AND (kind = o_kind OR kind = '' OR o_kind = '') AND size(array_except(content, o_content)) = 0"
        " AND (size(o_content) > size(content) OR o_support > support OR (o_support = support AND other < entity))"
    )
    best = F.max(F.struct((F.size("o_content") == F.size("content")).alias("same"), "o_support", (-F.col("other")).alias("key")))
    return fits.groupBy(F.col("entity").alias("a")).agg((-best["key"]).alias("b"))
