"""Connected components of a graph given as edges, by the smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node that can be reached.

    Each round a node takes the smallest label among its neighbours', then the label of that label. Labels only fall and
    stay inside their component; when a round changes none, all nodes of a component agree.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        nxt = written(lower.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label")), "labels")
        done = nxt.where("label < old").isEmpty()
        labels = nxt.select("node", "label")
        if done:
            return labels.select("node", F.col("label").alias("component"))
