"""Connected components of an edge table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendwatch.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b longs): component is
    the smallest node reachable. Labels take the smallest label among the
    neighbours and then their label's label, so paths shorten by half each
    round; every round is written out, and only the number of changed labels
    reaches the driver. A node with very many neighbours is pre-aggregated
    before the shuffle."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct())
    labels = materialize(both.groupBy("node").agg(F.min("other").alias("component"))
                         .select("node", F.least("node", "component").alias("component")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("seen")), "other")
                .groupBy("node").agg(F.min("seen").alias("seen")))
        took = labels.join(near, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "seen").alias("component"))
        beyond = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = materialize(took.join(beyond, "component", "left").select(
            "node", "was", F.least("component", "next").alias("component")))
        if not new.filter("was <> component").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")
