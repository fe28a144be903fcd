"""Connected components of links between long ids, by smallest-label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every id in `edges` (a, b); root is the smallest id that links reach.

    Each superstep takes the smallest label among a node's neighbours and then the label of that label, so paths
    halve. Sums by node combine before they are shuffled and joins on a hub are split by adaptive execution; every
    superstep is written to the shared folder, which ends lineage. No edges give no rows.
    """
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct(), "links", narrow=True)
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels", narrow=True)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        stepped = materialize(lower.join(up, "root").select("node", "was", F.least("root", "above").alias("root")), "labels", narrow=True)
        moved = stepped.where("root <> was").limit(1).count()
        release(labels)
        labels = stepped
        if not moved:
            return labels.select("node", "root")
