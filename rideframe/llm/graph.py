"""Connected components of narrow link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideframe.llm.common import dropped, spread_join, written


def components(links: DataFrame) -> DataFrame:
    """(node, class_id): the least node of each component, for nodes that have a link.

    ``links`` has two long columns, a and b. Each round every node takes the least label of
    its neighbours, then the label of its label (pointer jumping), so stars end after two
    rounds and paths after about log2 of their length. Every round is written to the shared
    folder; all aggregates combine before the shuffle, and nodes or labels that many rows
    share are joined by broadcast.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "links")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = spread_join(both, labels.withColumnRenamed("node", "b"), "b", "inner").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = written(step, "step")
        # a root takes what its members have found, so that whole components move at once
        roots = step.where("label < was").groupBy(F.col("was").alias("node")).agg(F.min("label").alias("root"))
        moved = written(step.join(roots, "node", "left").select("node", "was", F.least("label", "root").alias("label")), "moved")
        up = moved.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = written(spread_join(moved, up, "label").select("node", "was", F.least("label", "up").alias("label")), "labels")
        dropped(labels, step, moved)
        labels = jumped
        if jumped.where("label <> was").isEmpty():
            dropped(both)
            return jumped.select("node", F.col("label").alias("class_id"))
