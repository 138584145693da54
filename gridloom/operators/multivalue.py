"""Several values packed in one field, split into one value per row.

No delimiter is fixed beforehand. Every field becomes a lattice of possible
splits; expectation-maximisation learns from the whole column how often each
value *shape* occurs, and Viterbi takes the likeliest path. A slash or a blank
that belongs to a number therefore stays in it, because the whole shape is
frequent while its parts are not. Quoted spans are atomic.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut_lineage

#: Private characters that stand in a pattern for what they replace, place by place.
ALNUM, JOINER, NUMBERING, INVISIBLE = "x", "", "", ""

#: Words that join the last two values of a list, in the languages of the forms.
CONJUNCTIONS = ("i", "te", "и", "те", "and", "und", "et")


#: By field: expected occurrences of each shape, and their total.
Shapes = dict[str, tuple[dict[str, float], float]]


@dataclass(frozen=True)
class SplitModel:
    """Parameters of the segmentation; none depends on the size of the data.

    ``inner`` is the prior factor of each separator kept inside a value, ``novelty`` the
    weight of a shape not seen before, ``empty`` the prior of an empty slot and
    ``stray_blank`` the share of values typed with blanks of their own. ``longest`` is the
    number of separators a value may hold beside others in its field; one that fills its
    field may hold any number. Expectation-maximisation ends when a round moves less than
    ``settled`` of all values; not doing so in ``rounds`` is an error. Up to ``held``
    shapes are sent to the tasks; more are joined to the patterns that need them.
    """

    rounds: int = 200
    settled: float = 1e-3
    longest: int = 8
    inner: float = 0.05
    novelty: float = 0.5
    empty: float = 1e-3
    stray_blank: float = 0.1
    held: int = 20_000


def field_pattern(value: Column) -> Column:
    """The field with letters and digits levelled, of the same length in code points."""
    p = F.regexp_replace(value, r"[\x{e001}-\x{e003}]", "?")
    p = F.regexp_replace(p, r"\p{Cf}", INVISIBLE)
    p = F.regexp_replace(p, r"(^|[\s,;|])\((\d)\)(?=\s)", f"$1({NUMBERING})")
    for opening in (r"\(", ""):
        for digits in (1, 2):
            mark = ("(" if opening else "") + NUMBERING * digits
            p = F.regexp_replace(p, rf"(^|[\s,;|]){opening}\d{{{digits}}}([.):])(?=\s)", f"$1{mark}$2")
    for word in CONJUNCTIONS:
        p = F.regexp_replace(p, rf"(?iu)(?<=\s){word}(?=\s)", JOINER * len(word))
    return F.regexp_replace(p, r"[\p{L}\p{N}]", ALNUM)


_WS = r"[^\S\r\n\t]"
_TOKEN = re.compile(
    rf"""
    (?P<quote>"[^"]*x[^"]*"|＂[^＂]*x[^＂]*＂|„[^“”„]*x[^“”„]*[“”]|“[^“”]*x[^“”]*”|«[^«»]*x[^«»]*»
        |(?<![x])'[^']*x[^']*'(?!x)|(?<![x])＇[^＇]*x[^＇]*＇(?!x)|‘[^‘’]*x[^‘’]*’)
  | (?P<number>\(?{NUMBERING}+[.):]{_WS}*)
  | (?P<strong>{_WS}*(?:\|\||//|[,;，；]{_WS}*(?:\r\n|\r|\n)|(?:\r\n|\r|\n)|\t|[,;|/&+，；｜／＆＋]){_WS}*
        |\s+{JOINER}+\s+)
  | (?P<weak>\s+)
  | (?P<text>[^\s,;|/&+，；｜／＆＋"'„“«‘＂＇{NUMBERING}{JOINER}]+|.)
    """,
    re.VERBOSE | re.DOTALL,
)
_SHAPE_BLANKS = re.compile(r"\s+")

#: A stretch between separators: start, end, whether it is quoted; and the separator after it.
Atom = tuple[int, int, bool]


def atoms_of(pattern: str) -> tuple[list[Atom], list[bool]]:
    """Stretches between separators, and for each gap whether it is a strong one."""
    atoms: list[Atom] = []
    gaps: list[bool] = []
    start = end = None
    quoted = False

    def close(strong: bool) -> None:
        nonlocal start, end, quoted
        at = start if start is not None else 0
        atoms.append((at, end if start is not None else at, quoted))
        gaps.append(strong)
        start, end, quoted = None, None, False

    lo, hi = len(pattern) - len(pattern.lstrip()), len(pattern.rstrip())
    for m in _TOKEN.finditer(pattern, lo, hi):
        kind = m.lastgroup
        if kind == "quote":
            if start is not None:
                close(True)
            start, end, quoted = m.start(), m.end(), True
        elif kind == "number":
            if start is not None:
                close(True)
        elif kind == "strong":
            close(True)
        elif kind == "weak":
            if start is not None:
                close(False)
        else:
            if quoted:
                close(True)
            start = m.start() if start is None else start
            end = m.end()
    if start is not None:
        atoms.append((start, end, quoted))
    elif gaps:
        gaps.pop()
    while atoms and ALNUM not in pattern[atoms[-1][0] : atoms[-1][1]]:
        atoms.pop()
        if gaps:
            gaps.pop()
    del gaps[max(0, len(atoms) - 1) :]
    while atoms and ALNUM not in pattern[atoms[0][0] : atoms[0][1]]:
        atoms.pop(0)
        if gaps:
            gaps.pop(0)
    return atoms, gaps


def _bare(pattern: str, atom_a: Atom, atom_b: Atom) -> tuple[int, int]:
    """The segment without enclosing quotes and blanks."""
    lo, hi = atom_a[0], atom_b[1]
    if atom_a[2]:
        lo, hi = lo + 1, hi - 1
    while lo < hi and pattern[lo].isspace():
        lo += 1
    while hi > lo and pattern[hi - 1].isspace():
        hi -= 1
    return lo, hi


class Lattice:
    """All splits of one pattern that keep quoted spans whole."""

    def __init__(self, pattern: str, model: SplitModel) -> None:
        self.pattern = pattern
        self.atoms, self.gaps = atoms_of(pattern)
        self.edges: list[list[tuple[int, str | None, int]]] = []  # by end: (first atom, shape, separators inside)
        for j, last in enumerate(self.atoms):
            here: list[tuple[int, str | None, int]] = []
            reach = range(j, max(-1, j - model.longest - 1), -1)
            for i in (*reach, 0) if j == len(self.atoms) - 1 and reach[-1] > 0 else reach:
                first = self.atoms[i]
                if i < j and (first[2] or last[2] or any(a[2] for a in self.atoms[i + 1 : j])):
                    break
                if i < j and (first[0] == first[1] or last[0] == last[1]):
                    continue  # a value neither begins nor ends with an empty slot
                lo, hi = _bare(pattern, first, last)
                text = pattern[lo:hi].replace(INVISIBLE, "")
                if ALNUM in text:
                    # Separators on both sides of nothing mark a slot; hardly any value holds one.
                    hollow = sum(ALNUM not in pattern[a[0] : a[1]] for a in self.atoms[i + 1 : j])
                    here.append((i, _SHAPE_BLANKS.sub(" ", text), j - i + 3 * hollow))
                elif i == j:
                    here.append((i, None, 0))
            self.edges.append(here)

    def _logs(self, probability) -> list[list[tuple[int, str | None, float]]]:
        return [[(i, s, math.log(probability(s, k))) for i, s, k in here] for here in self.edges]

    def expected(self, probability) -> dict[str, float]:
        """Expected occurrences of each shape over all splits (forward-backward)."""
        n = len(self.atoms)
        logs = self._logs(probability)
        forward = [0.0] + [-math.inf] * n
        for j in range(n):
            forward[j + 1] = _log_sum([forward[i] + w for i, _, w in logs[j]])
        backward = [-math.inf] * n + [0.0]
        incoming: list[list[float]] = [[] for _ in range(n)]
        for j in range(n - 1, -1, -1):
            for i, _, w in logs[j]:
                incoming[i].append(w + backward[j + 1])
            backward[j] = _log_sum(incoming[j]) if incoming[j] else -math.inf
        counts: dict[str, float] = defaultdict(float)
        for j in range(n):
            for i, s, w in logs[j]:
                if s is not None:
                    counts[s] += math.exp(forward[i] + w + backward[j + 1] - forward[n])
        return counts

    def best(self, probability) -> list[tuple[int, int, int]]:
        """The likeliest split: (slot from 1, start, end) of every value in it."""
        n = len(self.atoms)
        score, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for j, here in enumerate(self._logs(probability)):
            for i, _, w in here:
                if score[i] + w > score[j + 1]:
                    score[j + 1], back[j + 1] = score[i] + w, i
        cuts, j = [], n
        while j > 0:
            cuts.append((back[j], j - 1))
            j = back[j]
        out = []
        slot = 0
        for k, (i, j) in enumerate(reversed(cuts)):
            lo, hi = _bare(self.pattern, self.atoms[i], self.atoms[j])
            slot += 1
            if ALNUM in self.pattern[lo:hi]:
                out.append((slot, lo, hi))
            elif k and not self.gaps[i - 1]:
                slot -= 1  # a blank beside nothing is no slot
        return out


def _log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in xs))


def shape_probability(shapes: Shapes, field: str, model: SplitModel):
    """Learned frequency of the shapes of a field, all of them at hand."""
    known, total = shapes.get(field, ({}, 0.0))
    squeezed: dict[str, float] = defaultdict(float)
    for shape, n in known.items():
        squeezed[shape.replace(" ", "")] += n
    return _probability(known, squeezed, total, model)


def _probability(known: dict[str, float], squeezed: dict[str, float], total: float, model: SplitModel):
    """Learned frequency, smoothed with a prior that dislikes separators inside a value.

    A value typed with stray blanks also profits from what its shape with other blanks, or none, is worth.
    """

    def probability(shape: str | None, inside: int) -> float:
        if shape is None:
            return model.empty
        # A shape with separators must have been met elsewhere too: one occurrence proves nothing.
        # A long one may have too small a prior for a number; it is not impossible.
        n = max(0.0, known.get(shape, 0.0) - (inside > 0)) + max(model.novelty * model.inner**inside, 1e-300)
        if " " in shape:
            n += model.stray_blank * max(0.0, squeezed.get(shape.replace(" ", ""), 0.0) - known.get(shape, 0.0))
        return n / (total + model.novelty)

    return probability


class _ByField(dict):
    """The probability function of each field, made once a task."""

    def __init__(self, shapes: Shapes, model: SplitModel) -> None:
        super().__init__()
        self._shapes, self._model = shapes, model

    def __missing__(self, field: str):
        self[field] = shape_probability(self._shapes, field, self._model)
        return self[field]


@dataclass(frozen=True)
class Learned:
    """What was learned: shapes held at the driver, or a table of them with the patterns that need each."""

    totals: dict[str, float]
    held: Shapes | None
    table: DataFrame | None = None
    needs: DataFrame | None = None

    def over(self, patterns: DataFrame, model: SplitModel, run: Callable[[pd.DataFrame, Callable[[int, str], Callable]], pd.DataFrame], schema: str) -> DataFrame:
        """``run`` on batches of patterns, given the probability function of each row."""
        totals, held = self.totals, self.held
        if held is not None:

            def all_held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                by_field = _ByField(held, model)
                for pdf in batches:
                    yield run(pdf, lambda _, field: by_field[field])

            return patterns.mapInPandas(all_held, schema)
        squeezed = F.replace("shape", F.lit(" "), F.lit(""))
        alike = self.table.groupBy("field", squeezed.alias("bare")).agg(F.sum("n").alias("n"))
        of_shape = self.needs.join(self.table, ["field", "shape"]).select("field", "pattern", "shape", "n")
        # All shapes that differ from a needed one in blanks only, as one shape without.
        others = self.needs.where("shape LIKE '% %'").select("field", "pattern", squeezed.alias("bare")).distinct().join(alike, ["field", "bare"])
        rest = others.select("field", "pattern", "bare", "n")
        own = (
            of_shape.select("field", "pattern", F.struct("shape", "n", F.lit(True).alias("own")).alias("s"))
            .unionByName(rest.select("field", "pattern", F.struct(F.col("bare").alias("shape"), "n", F.lit(False).alias("own")).alias("s")))
            .groupBy("field", "pattern")
            .agg(F.collect_list("s").alias("shapes"))
        )

        def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = pdf["shapes"].tolist()

                def of(i: int, field: str, rows=rows):
                    mine = rows[i] if rows[i] is not None else []
                    known = {x["shape"]: x["n"] for x in mine if x["own"]}
                    bare = {x["shape"]: x["n"] for x in mine if not x["own"]}
                    return _probability(known, bare, totals.get(field, 0.0), model)

                yield run(pdf, of)

        return patterns.withColumnRenamed("_field", "field").join(own, ["field", "pattern"], "left").withColumnRenamed("field", "_field").mapInPandas(joined, schema)


def learn_shapes(patterns: DataFrame, model: SplitModel) -> Learned:
    """EM over distinct patterns with their counts, for every field at once.

    Patterns that can be read one way only are counted once; each round is one pass
    over the others and one aggregation by shape.
    """
    schema = "field string, shape string, n double"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Shapes of patterns without a choice (no separator, or all of it quoted); of others those that may occur."""
        for pdf in batches:
            rows = []
            for f, p, n in zip(pdf["_field"], pdf["pattern"], pdf["n"], strict=True):
                lat = Lattice(p, model)
                sure = len(lat.atoms) == 1 or all(a[2] for a in lat.atoms)
                found = Counter(s for here in lat.edges for _, s, k in here if s is not None and (k == 0 or not sure))
                rows += [(f, p, s, float(n * c), sure) for s, c in found.items()]
            yield pd.DataFrame(rows, columns=["field", "pattern", "shape", "n", "sure"])

    edges = cut_lineage(patterns.mapInPandas(read, "field string, pattern string, shape string, n double, sure boolean"))
    sure = edges.where("sure").groupBy("field", "shape").agg(F.sum("n").alias("n"))
    needs = edges.where("NOT sure").select("field", "pattern", "shape")
    # Every field has a value at least: what is new is rare from the start. One row a field.
    sizes = {r["_field"]: float(r["n"]) for r in patterns.groupBy("_field").agg(F.sum("n").alias("n")).collect()}
    open_ = cut_lineage(
        patterns.join(needs.select(F.col("field").alias("_field"), "pattern").distinct(), ["_field", "pattern"], "left_semi")
    )

    def learned(table: DataFrame) -> Learned:
        table = cut_lineage(table)
        totals = {r["field"]: r["n"] for r in table.groupBy("field").agg(F.sum("n").alias("n")).collect()}
        totals = {f: max(n, totals.get(f, 0.0)) for f, n in sizes.items()}
        if table.count() > model.held:
            return Learned(totals, None, table, needs)
        shapes: Shapes = {f: ({}, n) for f, n in totals.items()}
        for r in table.collect():  # at most model.held
            shapes[r["field"]][0][r["shape"]] = r["n"]
        return Learned(totals, shapes, table, needs)

    def expect(pdf: pd.DataFrame, probability: Callable[[int, str], Callable]) -> pd.DataFrame:
        sums: dict[tuple[str, str], float] = defaultdict(float)
        for i, (f, p, n) in enumerate(zip(pdf["_field"], pdf["pattern"], pdf["n"], strict=True)):
            for s, c in Lattice(p, model).expected(probability(i, f)).items():
                sums[f, s] += c * n
        return pd.DataFrame([(f, s, n) for (f, s), n in sums.items()], columns=["field", "shape", "n"])

    now = learned(sure)
    if not open_.limit(1).count():
        return now
    for _ in range(model.rounds):
        found = now.over(open_, model, expect, schema).unionByName(sure)
        new = learned(found.groupBy("field", "shape").agg(F.sum("n").alias("n")))
        before = now.table.select("field", "shape", F.col("n").alias("was"))
        gap = new.table.join(before, ["field", "shape"], "full").agg(F.sum(F.abs(F.coalesce("n", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0] or 0.0
        now = new
        if gap <= model.settled * sum(now.totals.values()):
            return now
    raise RuntimeError(f"the shapes of values did not settle in {model.rounds} rounds")


def split_fields(
    df: DataFrame,
    row_id: str,
    fields: Sequence[str],
    model: SplitModel = SplitModel(),
    hot_share: int = 1000,
) -> DataFrame:
    """One row per value of every field that holds at least two.

    Returns ``row_id, field_name, pos, item_value``. ``pos`` counts slots from 1 in
    field order; an empty slot between values keeps its number but has no row, and
    separators before the first or after the last value add none. ``item_value`` is
    the stored text without surrounding blanks, enclosing quotes and numbering.
    Null, empty and blank fields, and fields of one value, give no rows; very long
    fields cost time in proportion to their length. Repeated rows are split alike,
    and an empty table gives no rows. Other columns are ignored.

    Scale: the model sees distinct patterns with counts (combined before the
    shuffle), never rows. Patterns with at least ``1 / hot_share`` of all fields, at most
    ``hot_share`` in number, go to the rows by broadcast, so their rows are not moved;
    the others are joined.
    """
    long = df.select(
        F.col(f"`{row_id}`").alias("_id"),
        F.inline(F.array(*(F.struct(F.lit(f).alias("_field"), F.col(f"`{f}`").alias("_value")) for f in fields))),
    ).where(F.col("_value").rlike(r"[\p{L}\p{N}]"))
    # The column decides which shapes its values have, so patterns keep their field.
    long = long.withColumn("_pattern", field_pattern(F.col("_value")))
    patterns = cut_lineage(long.groupBy("_field", F.col("_pattern").alias("pattern")).agg(F.count(F.lit(1)).alias("n")))
    learned = learn_shapes(patterns, model)

    def decide(pdf: pd.DataFrame, probability: Callable[[int, str], Callable]) -> pd.DataFrame:
        rows = []
        for i, (f, p, n) in enumerate(zip(pdf["_field"], pdf["pattern"], pdf["n"], strict=True)):
            cut = Lattice(p, model).best(probability(i, f))
            if len(cut) > 1:
                rows.append((f, p, n, [{"pos": s, "at": a, "len": b - a} for s, a, b in cut]))
        return pd.DataFrame(rows, columns=["_field", "_pattern", "_n", "_cut"])

    schema = "_field string, _pattern string, _n bigint, _cut array<struct<pos:bigint,at:int,len:int>>"
    parts = cut_lineage(learned.over(patterns, model, decide, schema))
    hot = F.col("_n") * hot_share >= (patterns.agg(F.sum("n")).first()[0] or 0)
    frequent, others = F.broadcast(parts.where(hot)), parts.where(~hot)  # at most hot_share patterns
    keys = ["_field", "_pattern"]
    met = long.join(frequent, keys).unionByName(long.join(frequent.select(*keys), keys, "left_anti").join(others, keys))
    return met.select("_id", "_field", "_value", F.inline("_cut")).select(
        F.col("_id").alias(row_id), F.col("_field").alias("field_name"), "pos", F.expr("substring(_value, at + 1, len)").alias("item_value")
    )


def p4_found(equipment: DataFrame) -> DataFrame:
    return split_fields(equipment, "item_id", ("serial_number", "inventory_number"))
