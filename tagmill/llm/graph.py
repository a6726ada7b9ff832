"""Connected components of a link table, without bringing links to the driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.storage import settle


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``): the least node that links reach.

    Every round takes the least label among the neighbours and then the label of that label, so a
    chain halves with each round. Each round is written, so a lost executor repeats that round only.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = settle(both, "links")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b")
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(least, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        roots = labels.select(F.col("node").alias("label"), F.col("component").alias("root"))
        moved = step.join(roots, "label", "left").select("node", "old", F.coalesce(F.least("label", "root"), "label").alias("component"))
        moved = settle(moved, "labels")
        labels = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            return labels
