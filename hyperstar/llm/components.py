"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(u, v)``: the label is a node of
    its component, the same for all nodes of a component.

    Each round gives every node the smallest of itself and its neighbours and
    contracts the edges to those; a round at least halves the nodes that still
    have edges in expectation, as labels are in no order that the graph knows.
    Rounds go through tables in the shared folder. Hubs are no hot spot: minima
    aggregate before the shuffle, and the joins on nodes are plain equi-joins
    that adaptive execution splits.
    """
    edges = written(edges.select("u", "v").where("u <> v").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
        if labels is None:
            labels = least
        else:
            step = least.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = written(labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
        on = lambda end: least.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))  # noqa: E731, B023
        edges = written(edges.join(on("u"), "u").join(on("v"), "v").select(F.least("u_label", "v_label").alias("u"), F.greatest("u_label", "v_label").alias("v")).where("u <> v").distinct())
    return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
