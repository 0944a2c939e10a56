"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (src, dst); component is the smallest node reachable.

    Each round takes the smallest label among the neighbours and then the label of
    that label, so long chains shrink geometrically. Rounds are written to the shared
    folder; joins are between plain tables so that adaptive execution can split hubs.
    Null ends and self-loops are left out. No edges give an empty table.
    """
    one_way = edges.where("src is not null and dst is not null and src != dst").select("src", "dst")
    both = materialize(one_way.union(one_way.select("dst", "src")).toDF("a", "b").distinct(), "edges")
    table = labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    for _ in range(rounds):
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, labels["node"] == heard["a"]).select("node", F.col("component").alias("old"), F.least("component", "heard").alias("near"))
        far = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        following = materialize(nearer.join(far, "near", "left").select("node", "old", F.least("near", "far").alias("component")), "labels")
        discard(table)
        table, labels = following, following.select("node", "component")
        if following.where("old != component").isEmpty():
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
