"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.runtime import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an undirected edge table (a long, b long): (node, component).

    Each round takes the least label among neighbours and then jumps to that label's own label, so the number of rounds
    grows with the logarithm of a component's width. Rounds end on written tables in the shared folder. Null ends and loops are left
    out; repeated edges change nothing; nodes without edges do not appear.
    """
    both = edges.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        seen = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", "component", F.least("component", "m").alias("m"))
        jump = labels.select(F.col("node").alias("m"), F.col("component").alias("j"))
        new = materialize(seen.join(jump, "m", "left").select("node", F.least("m", "j").alias("component"), F.col("component").alias("old")), "labels")
        changed = new.filter("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
