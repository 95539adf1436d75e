"""Connected components of a link table by contraction.

Each node points to its smallest neighbour, pointers are doubled until they reach the smallest node of their tree, and trees
become nodes. A round at least halves the nodes that still have links, and takes as many joins as the depth has bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphreports.runtime import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to (node, root): root is the smallest node that can be reached. Nodes without links have no row."""
    links = cut_lineage(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = cut_lineage(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")))
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        parent = ends.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("parent"))
        parent, moved = cut_lineage(parent), True
        while moved:
            parent = cut_lineage(_jump(parent))
            moved = not parent.filter("moved").isEmpty()
        links = _renamed(_renamed(links, parent, "a"), parent, "b").filter("a <> b")
        links = cut_lineage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        labels = cut_lineage(_renamed(labels, parent, "root"))
    return labels


def _jump(parent: DataFrame) -> DataFrame:
    """Each node's parent's parent; ``moved`` tells whether that is another."""
    up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
    top = F.coalesce("top", "parent")
    return parent.select("node", "parent").join(up, "parent", "left").select("node", top.alias("parent"), (top != F.col("parent")).alias("moved"))


def _renamed(df: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    to = parent.select(F.col("node").alias(column), F.col("parent").alias("__to"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to").select(*df.columns)
