"""Mixing sources to target weights by entropy balancing.

Document rates stay as close as possible to their base rates, in the sense of the
entropy of documents, while every source contributes its target share of all tokens
and no rate exceeds the cap. The solution tilts every document exponentially with its
size, ``rate = min(cap, base * exp(dual * size))``; the convex dual has one multiplier
a source, found by distributed Newton iterations whose gradient and Hessian are one
aggregation a round. The tilted rates are then rounded into copies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.tokens import TokenizerFile, count_tokens
from gridloom.session import cut_lineage


def feasible_total(tokens: dict[str, float], targets: dict[str, tuple[float, int]]) -> tuple[float, dict[str, float]]:
    """The largest mix that meets all shares within the caps, and the shares it can meet.

    Sources without tokens cannot contribute; the others keep their proportions.
    """
    live = {s: share for s, (share, cap) in targets.items() if share > 0 and cap > 0 and tokens.get(s, 0) > 0}
    whole = sum(live.values())
    shares = {s: x / whole for s, x in live.items()} if whole else {}
    return min((tokens[s] * targets[s][1] / x for s, x in shares.items()), default=0.0), shares


@dataclass
class _Multiplier:
    """The dual of one source: its multiplier and the interval that is known to hold the root."""

    goal: float
    cap: float
    unit: float
    value: float = 0.0
    low: float = -math.inf
    high: float = math.inf

    def step(self, drawn: float, slope: float) -> float:
        """One Newton step from the gradient and the Hessian; returns the relative gap before it.

        The step is taken on the logarithm of the constraint, which has the same root
        and is straight where the tilt rules; outside the interval it is halved instead.
        """
        gap = math.log(drawn / self.goal) if drawn > 0 else -math.inf
        if gap > 0:
            self.high = self.value
        else:
            self.low = self.value
        new = self.value - gap * drawn / slope if slope > 0 and drawn > 0 else math.nan
        if not self.low < new < self.high:
            if math.isinf(self.low) or math.isinf(self.high):
                new = self.value + math.copysign(max(1.0, abs(self.value)), -gap)
            else:
                new = (self.low + self.high) / 2
        self.value = new
        return abs(gap)


def solve_dual(
    sized: DataFrame, goal: dict[str, float], caps: dict[str, int], rounds: int = 200, tolerance: float = 1e-9
) -> tuple[dict[str, float], list[float]]:
    """Multipliers ``m`` with sum of ``tokens * min(cap, base * exp(m * tokens))`` = goal in every source.

    The gradient of the dual is the gap of the token constraints. Its Hessian is
    diagonal, because a document has one source and so counts in one constraint only;
    both come from one aggregation a round. A goal that only all caps together reach
    has no finite multiplier and gets infinity. Returns the multipliers and the largest
    relative gap of each round; raises if a gap is left after ``rounds``, each of
    which at least halves an interval once it is closed.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.avg("n_tokens").alias("unit")).collect()  # one row a source
    facts = {r["source"]: (float(r["t"]), float(r["unit"])) for r in sums}
    dual = {s: math.inf for s, g in goal.items() if g >= facts[s][0] * caps[s] * (1 - tolerance)}
    open_ = {s: _Multiplier(g, float(caps[s]), facts[s][1]) for s, g in goal.items() if s not in dual}
    gaps: list[float] = []
    while open_:
        if len(gaps) == rounds:
            raise RuntimeError(f"entropy balancing left a gap of {gaps[-1]:.3g} after {rounds} rounds")
        state = spark.createDataFrame([(s, m.value, m.cap, m.unit) for s, m in open_.items()], "source string, dual double, cap double, unit double")
        size = F.col("n_tokens") / F.col("unit")
        rate = F.col("base_rate") * F.exp(F.col("dual") * size)
        rows = (
            sized.join(F.broadcast(state), "source")  # one row a target source
            .groupBy("source")
            .agg(
                F.sum(F.col("n_tokens") * F.least(rate, F.col("cap"))).alias("gradient"),
                F.sum(F.when(rate < F.col("cap"), F.col("n_tokens") * size * rate).otherwise(0.0)).alias("hessian"),
            )
            .collect()
        )
        worst = 0.0
        for r in rows:
            m = open_[r["source"]]
            at = m.value
            gap = m.step(r["gradient"], r["hessian"])
            worst = max(worst, gap)
            if gap <= tolerance or (m.high - m.low) <= 1e-15 * max(1.0, abs(at)):
                dual[r["source"]] = at / m.unit
                del open_[r["source"]]
        gaps.append(worst)
    return dual, gaps


def round_by_tokens(rates: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Copies of each document, its rate rounded up or down so that tokens come out even.

    What rounding gained or lost so far is carried to the next document; with the
    largest documents first, the small ones at the end even out what is left.
    """
    low = np.floor(rates + 1e-9)
    part = np.maximum(rates - low, 0.0) * tokens
    out = low.astype(np.int64)
    owed = 0.0
    for i, (due, t) in enumerate(zip(part.tolist(), tokens.tolist(), strict=True)):
        owed += due
        # Where the cap is reached there is no part to round up.
        if due > 0 and owed * 2 >= t:
            out[i] += 1
            owed -= t
    return out


def draw(
    docs: DataFrame,
    targets: DataFrame,
    tokenizer: TokenizerFile,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    base_rate: str | None = None,
    block: int = 50_000,
) -> DataFrame:
    """The chosen documents: ``doc_id, source, n_tokens, rate, n_uses, target_share, reached_share``.

    The mix is the largest in which all shares are met with no document used more than
    ``max_repeats`` times. A source without documents cannot be met and the others keep
    their proportions; sources not listed, null or empty are not drawn, nor are
    documents without tokens; a share of 0 draws nothing. Repeated rows are documents
    of their own. An empty table, or targets that nothing can meet, give no rows.
    Other columns are ignored.

    Rates are tilted by size, so a source short of its goal draws its long documents
    more often and one beyond it its short ones. Rounding is by tokens: in blocks of
    about ``block`` documents of a source, the largest first, each rate is rounded up
    or down so that the tokens drawn so far stay closest to those due.

    Scale: texts are read once; the table of identifiers, sources and sizes is written
    to the shared checkpoint folder and scanned by the iterations. Blocks are made by a
    hash, so a source with a third of all documents is many tasks. Only one row a
    source reaches the driver, and the list of sources is given.
    """
    spark = docs.sparkSession
    rows = [r for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"] is not None]
    wanted = {r["source"]: (float(r["target_share"] or 0.0), int(r["max_repeats"] or 0)) for r in rows}
    listed = docs.where(F.col(f"`{source}`").isin([s for s, (share, cap) in wanted.items() if share > 0 and cap > 0]))
    base = F.coalesce(F.col(f"`{base_rate}`").cast("double"), F.lit(0.0)) if base_rate else F.lit(1.0)
    ready = listed.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), base.alias("base_rate"), F.col(f"`{text}`").alias("text")
    )
    sized = cut_lineage(count_tokens(ready, "text", tokenizer, ("doc_id", "source", "base_rate")).where("n_tokens > 0 AND base_rate > 0"))
    size = {r["source"]: (r["t"], r["n"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    total, shares = feasible_total({s: t for s, (t, _) in size.items()}, wanted)
    key = sized.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {key}, source string, n_tokens bigint, rate double, n_uses bigint"
    if not shares:
        return spark.createDataFrame([], f"{out}, target_share double, reached_share double").withColumnRenamed("doc_id", doc_id)
    goal = {s: total * x for s, x in shares.items()}
    caps = {s: wanted[s][1] for s in shares}
    dual, _ = solve_dual(sized, goal, caps)
    rates = tilted_rates(spark, sized, dual, caps, {s: max(1, -(-size[s][1] // block)) for s in shares})

    def sample(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n_tokens", "descending"), ("spread", "ascending"), ("doc_id", "ascending")])
        uses = round_by_tokens(group.column("rate").to_numpy(), group.column("n_tokens").to_numpy())
        return pa.table({c: group.column(c) for c in ("doc_id", "source", "n_tokens", "rate")} | {"n_uses": pa.array(uses)})

    drawn = cut_lineage(rates.groupBy("source", "block").applyInArrow(sample, out).where("n_uses > 0"))
    sums = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("n")).collect()  # one row a source
    reached = {r["source"]: float(r["n"]) for r in sums}
    whole = sum(reached.values()) or 1.0
    about = spark.createDataFrame([(s, wanted[s][0], n / whole) for s, n in reached.items()], "source string, target_share double, reached_share double")
    return drawn.join(F.broadcast(about), "source").select(  # one row a target source
        F.col("doc_id").alias(doc_id), "source", "n_tokens", "rate", "n_uses", "target_share", "reached_share"
    )


def tilted_rates(spark: SparkSession, sized: DataFrame, dual: dict[str, float], caps: dict[str, int], blocks: dict[str, int]) -> DataFrame:
    """Every document with its rate and a block of its source."""
    state = spark.createDataFrame([(s, dual[s], float(caps[s]), blocks[s]) for s in dual], "source string, dual double, cap double, blocks int")
    spread = F.xxhash64("doc_id")
    return sized.join(F.broadcast(state), "source").select(  # one row a target source
        "doc_id", "source", "n_tokens",
        F.least(F.col("base_rate") * F.exp(F.col("dual") * F.col("n_tokens")), F.col("cap")).alias("rate"),
        spread.alias("spread"), F.pmod(spread, F.col("blocks")).cast("int").alias("block"),
    )


def shares_report(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """By listed source: target and reached share, tokens, documents and copies drawn, and the most uses."""
    got = chosen.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("n_uses")).alias("n_tokens"),
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_uses").alias("n_copies"),
        F.max("n_uses").alias("most_uses"),
        F.max("reached_share").alias("reached_share"),
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_tokens", "n_docs", "n_copies", "most_uses")}
    return (
        targets.join(got, "source", "left")
        .withColumns(zero | {"reached_share": F.coalesce("reached_share", F.lit(0.0))})
        .select("source", "target_share", "reached_share", "max_repeats", "most_uses", "n_docs", "n_copies", "n_tokens")
    )
