"""Connected components of a link table, by labels that spread and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.llm.common import materialize


def components(links: DataFrame, *, name: str = "components") -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node in ``links`` (long columns ``a, b``).

    Each round gives a node the least label around it, then the label of its
    label, so long chains shrink by halves and stars end in two rounds.  Labels
    are written to the shared folder between rounds; the driver sees one count.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-0")
    round_ = 0
    while True:
        round_ += 1
        around = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        spread = materialize(labels.join(around, "node").select("node", F.col("component").alias("old"), F.least("component", "least").alias("component")), f"{name}-{round_}")
        of_label = spread.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = spread.join(of_label, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component"))
        jumped = materialize(jumped, f"{name}-{round_}j")
        changed = jumped.where("old <> component").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels


def merge(joined: DataFrame, links: DataFrame, *, name: str) -> DataFrame:
    """``joined`` (node, component) after further ``links`` (a, b): only the components are linked anew."""
    if links.isEmpty():
        return joined
    of = lambda column: joined.select(F.col("node").alias(column), F.col("component").alias(f"_{column}"))
    lifted = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    higher = components(lifted, name=name)
    nodes = joined.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(joined, "node", "left_anti").withColumn("component", F.col("node")))
    moved = nodes.join(higher.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left")
    return materialize(moved.select("node", F.coalesce("further", "component").alias("component")), f"{name}-merged")
