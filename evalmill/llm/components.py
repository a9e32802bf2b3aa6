"""Connected components by smallest label, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.session import pin


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b); the label is the smallest node that can be reached.

    A round takes the smallest label among the neighbours, then the label of that label, so chains shrink by more
    than half. Minima are combined before the shuffle and joins have a unique side, so a hub is no single task.
    """
    both = pin(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = pin(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(seen, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = pin(nearer.join(jump, F.col("label") == F.col("at")).select("node", F.least("label", "further").alias("label"), "old"))
        if new.filter(F.col("label") != F.col("old")).isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
