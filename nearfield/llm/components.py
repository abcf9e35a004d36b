"""Connected components of a link table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """node, class_id (the smallest node of its component) for links (a, b), longs.

    Each round every node takes the smallest label of its neighbours, then the label of its
    label, so chains shorten by powers of two; it ends when no label moved.  Aggregations are
    partial before they shuffle, so a node with very many links costs a row for each task.
    Each round's labels are kept in the shared folder.
    """
    links = links.filter("a != b")
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("class_id")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("class_id").alias("m"))
        new = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("class_id").alias("was"), F.least("class_id", "m").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("class_id").alias("cc"))
        moved = cut(new.join(jump, "c", "left").select("node", "was", F.least("c", "cc").alias("class_id")))
        done = moved.filter("was != class_id").isEmpty()
        labels = moved.drop("was")
        if done:
            return labels
