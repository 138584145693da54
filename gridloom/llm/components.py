"""Connected components by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a`` and ``b``); the root is the smallest node.

    Each round takes the smallest label among neighbours and then the label of that
    label, so long chains halve. Rounds are written to the shared checkpoint folder;
    only a count reaches the driver.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", "root", F.least("root", "near").alias("low"))
        heads = labels.select(F.col("node").alias("low"), F.col("root").alias("head"))
        jumped = lower.join(heads, "low", "left").select("node", "root", F.least("low", F.coalesce("head", "low")).alias("next"))
        jumped = cut_lineage(jumped)
        if not jumped.where("next <> root").limit(1).count():
            return jumped.select("node", "root")
        labels = jumped.select("node", F.col("next").alias("root"))
