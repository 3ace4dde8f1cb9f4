"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (least node reachable) for every end of links(a, b).

    Each round takes the least label among neighbours and then the label's own label, and is
    written to the shared folder; rounds end when no label changes.  Nothing but the number of
    changes reaches the driver.  No links give no rows; self-links and repeats are harmless.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.distinct())
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "m").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        moved = stored(lower.join(up, "low", "left").select("node", F.least("low", F.coalesce("up", "low")).alias("new"), "label"))
        changed = moved.where("new != label").limit(1).count()
        labels = moved.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")
