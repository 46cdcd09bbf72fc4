"""Connected components of a link table, by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcred.session import cut


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node each node of ``links(a, b)`` is connected to.

    Labels combine before the shuffle, so a node in a third of all links is no hot key; every round's
    labels go to a reliable checkpoint. Jumps halve the way to the smallest label, so 60 rounds reach far beyond
    any table; labels that have not settled by then are an error. An empty table gives an empty table.
    """
    both = links.select("a", "b").filter("a is not null and b is not null and a <> b")
    edges = cut(both.union(both.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(most_rounds):
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("c"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("further"))
        step = cut(step.join(jump, "c", "left").select("node", F.least("c", F.coalesce("further", "c")).alias("component"), "old"))
        changed = step.filter("component <> old").limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
