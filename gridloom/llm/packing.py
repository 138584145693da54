"""Filling containers of fixed capacity with whole items: minimum bin slack.

Items are spread over windows. In a window every container takes the largest
item left and then the multiset of remaining lengths whose sum comes closest to
the free space, found by a bitset subset-sum program and traced back with counts.
A multiset found is repeated as often as the counts allow.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tokens import TokenizerFile, count_tokens


def closest_multiset(lengths: list[int], counts: dict[int, int], space: int) -> dict[int, int]:
    """Of the multiset ``counts``, the part with the greatest sum within ``space``.

    ``lengths`` are the distinct lengths in ascending order. Longer items are tried
    first, and the search stops as soon as the space can be filled exactly.
    """
    reach, trail = 1, []
    full = 1 << space
    mask = (full << 1) - 1
    for k in range(bisect_right(lengths, space) - 1, -1, -1):
        length = lengths[k]
        left = min(counts[length], space // length)
        step = 1
        while left:
            take = min(step, left)
            before = reach
            reach |= (reach << take * length) & mask
            if reach != before:
                trail.append((before, length, take))
            left -= take
            step *= 2
            if reach & full:
                left = 0
        if reach & full:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for before, length, take in reversed(trail):
        if not before >> total & 1:
            total -= take * length
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def fill_window(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container and place of every item of a window, both from 0. Sizes are at most ``capacity``.

    Items without length go into the first container. Equal sizes are taken in the
    order given, so the result is defined.
    """
    order = np.argsort(sizes, kind="stable")
    kinds, first, amount = np.unique(sizes[order], return_index=True, return_counts=True)
    stock = {int(s): order[a : a + n].tolist()[::-1] for s, a, n in zip(kinds, first, amount, strict=True)}
    container, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free_of_charge = stock.pop(0, [])
    lengths = sorted(stock)
    counts = {s: len(x) for s, x in stock.items()}
    number = 0
    while lengths:
        largest = lengths[-1]
        counts[largest] -= 1
        pattern = closest_multiset(lengths, counts, capacity - largest) if capacity > largest else {}
        counts[largest] += 1
        pattern[largest] = pattern.get(largest, 0) + 1
        times = min(counts[s] // k for s, k in pattern.items())
        for _ in range(times):
            at = 0
            for s in sorted(pattern, reverse=True):
                for _ in range(pattern[s]):
                    item = stock[s].pop()
                    container[item], place[item] = number, at
                    at += 1
            number += 1
        for s, k in pattern.items():
            counts[s] -= times * k
            if not counts[s]:
                lengths.remove(s)
    if free_of_charge:
        base = int(place[container == 0].max(initial=-1)) + 1 if number else 0
        for k, item in enumerate(reversed(free_of_charge)):
            container[item], place[item] = 0, base + k
    return container, place


def pack(
    docs: DataFrame,
    containers: DataFrame,
    tokenizer: TokenizerFile,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = 10_000,
) -> DataFrame:
    """Every text in containers of every capacity.

    Returns one row per piece: ``container_kind, capacity_tokens, container_id, place,
    doc_id, piece_no, start_token, end_token``. A text longer than the capacity is cut
    into full pieces, each a container of its own, and a rest that is packed with
    others; no other text is cut. Empty and null texts are pieces of no length. Equal
    texts and repeated rows are packed each by itself (identifiers are to be unique);
    an empty table gives no rows; other columns are ignored. A capacity that is null
    or not positive can hold nothing and is refused.

    Scale: texts are read once, for all capacities. Windows take about ``window``
    items by a hash of the identifier, so tasks stay equal whatever the lengths; each
    window leaves at most one container badly filled. Only identifiers and sizes are
    shuffled.
    """
    if containers.where(~F.coalesce(F.col("capacity_tokens") > 0, F.lit(False))).limit(1).count():
        raise ValueError("capacities must be positive")
    n = docs.count()
    windows = max(1, -(-n // window))
    sized = count_tokens(docs, text, tokenizer, (doc_id,)).withColumnRenamed(doc_id, "doc_id")
    kinds = [(r["container_kind"], int(r["capacity_tokens"])) for r in containers.select("container_kind", "capacity_tokens").distinct().collect()]
    kinds.sort(key=lambda x: (x[1], str(x[0])))
    each = F.explode(F.array(*(F.struct(F.lit(k).cast("string").alias("kind"), F.lit(c).alias("capacity")) for k, c in kinds)))
    items = sized.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(windows)).cast("int").alias("window"), each.alias("c")).select(
        "doc_id", "n_tokens", "window", "c.kind", "c.capacity"
    )
    key = items.schema["doc_id"].dataType.simpleString()

    def solve(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        capacity = group.column("capacity")[0].as_py()
        sizes = group.column("n_tokens").to_numpy()
        rest = np.where(sizes > capacity, sizes % capacity, sizes)
        packed = ~((sizes > capacity) & (rest == 0))
        container, place = fill_window(rest[packed], capacity)
        where, at = np.full(len(sizes), -1), np.full(len(sizes), -1)
        where[packed], at[packed] = container, place
        return pa.table(
            {
                "kind": group.column("kind"), "capacity": group.column("capacity"), "window": group.column("window"),
                "doc_id": group.column("doc_id"), "n_tokens": group.column("n_tokens"),
                "container": pa.array(where, pa.int64()), "place": pa.array(at, pa.int64()),
            }
        )

    solved = items.groupBy("kind", "capacity", "window").applyInArrow(
        solve, f"kind string, capacity int, window int, doc_id {key}, n_tokens bigint, container bigint, place bigint"
    )
    n_full = F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(F.lit(0)).cast("bigint")
    cap = F.col("capacity").cast("bigint")
    piece = lambda k, end, cid, at: F.struct(
        k.alias("piece_no"), (k * cap).alias("start_token"), end.alias("end_token"), cid.alias("container_id"), at.alias("place")
    )
    own = F.concat(F.col("kind"), F.lit(":doc:"), F.col("doc_id").cast("string"), F.lit(":"))
    full = F.transform(
        F.when(F.col("n_full") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("n_full") - 1)).otherwise(F.expr("array(cast(null as bigint))")),
        lambda k: piece(k, (k + 1) * cap, F.concat(own, k.cast("string")), F.lit(0).cast("bigint")),
    )
    shared = F.concat(F.col("kind"), F.lit(":"), F.col("window").cast("string"), F.lit(":"), F.col("container").cast("string"))
    last = F.array(piece(F.col("n_full"), F.col("n_tokens"), shared, F.col("place")))
    pieces = F.concat(F.when(F.col("n_full") > 0, full).otherwise(F.slice(last, 1, 0)), F.when(F.col("container") >= 0, last).otherwise(F.slice(last, 1, 0)))
    return (
        solved.withColumn("n_full", n_full)
        .select("kind", "capacity", "doc_id", F.explode(pieces).alias("p"))
        .select(
            F.col("kind").alias("container_kind"), F.col("capacity").alias("capacity_tokens"), "p.container_id", "p.place",
            F.col("doc_id").alias(doc_id), "p.piece_no", "p.start_token", "p.end_token",
        )
    )


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and the share of capacity used, by kind."""
    per = packed.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("used"))
    return per.groupBy("container_kind", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("used").alias("n_tokens"),
        (F.sum("used") / (F.count(F.lit(1)) * F.first("capacity_tokens"))).alias("fill"),
    )
