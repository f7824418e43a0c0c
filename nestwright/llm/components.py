"""Connected components of a link table by distributed label propagation with pointer jumping."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestwright.llm.work import Workspace


def connected_components(links: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """``links`` (a, b) to (node, label): the smallest node of each component, for nodes with a link.

    Every round takes the least label among a node's neighbours, then the label of that label, until no label moves; the
    distance that a label travels doubles with the rounds. Joins are on tables read back from the shared folder, so a
    node with very many links, or a label of very many nodes, is an ordinary skewed join that Spark splits.
    """
    edges = work.table(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct(), f"{name}-edges")
    labels = work.table(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), f"{name}-0")
    for k in count(1):
        near = edges.join(labels, edges.u == labels.node).select(F.col("v").alias("node"), "label").unionByName(labels)
        near = work.table(near.groupBy("node").agg(F.min("label").alias("label")), f"{name}-n{k}")
        up = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
        fresh = work.table(near.join(up, "label").select("node", F.least("label", "next").alias("label")), f"{name}-{k}")
        moved = fresh.withColumnRenamed("label", "now").join(labels, "node").where("now <> label").limit(1).count()
        work.drop(f"{name}-n{k}")
        work.drop(f"{name}-{k - 1}")
        labels = fresh
        if not moved:
            return labels
