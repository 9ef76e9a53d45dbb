"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node of ``edges`` (a, b).

    A round takes the least label among a node's own and its neighbours', then the label's own
    label. Labels never leave the executors; lineage is cut by a written table every round. The
    edges should be a forest or nearly so: no edge table of all pairs is needed. Rounds go on until
    no label changes; jumping makes them logarithmic in the longest path.

    Defined results: an edge with a null end, a loop or a repeated edge adds nothing (a loop names
    its node); an empty table gives no rows; further columns are ignored.
    """
    edges = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a")).distinct())
    labels = materialize(both.groupBy("node").agg(F.least("node", F.min("near")).alias("root")))
    while True:
        known = labels.select(F.col("node").alias("near"), F.col("root").alias("near_root"))
        seen = both.join(known, "near").groupBy("node").agg(F.min("near_root").alias("near_root"))
        lower = labels.join(seen, "node").select("node", "root", F.least("root", "near_root").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("next"))
        new = materialize(lower.join(jump, "low", "left").select("node", F.col("root").alias("old"), F.least("low", F.coalesce("next", "low")).alias("root")))
        labels = new.select("node", "root")
        if new.filter(F.col("old") != F.col("root")).isEmpty():
            return labels
