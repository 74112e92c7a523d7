"""Connected components of a graph of longs, in DataFrame joins over tables in the shared folder.

Each round points every node at its smallest neighbour, follows the pointers to their roots by doubling, and replaces
the edges by those between roots, of which there are at most half as many. Nothing is gathered on the driver but counts.

Cases: edges with a null end, loops and repeats are harmless; nodes without an edge to another node have no row; no
edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import around, scratch, write_table


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of every node of edges (a, b)."""
    outer = around()
    with scratch(edges.sparkSession):
        return write_table(_labels(edges), "components", outer)


def _labels(edges: DataFrame) -> DataFrame:
    ends = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = write_table(edges.filter("a <> b").select(ends.alias("e")).select("e.*").distinct(), "edges")
    labels = None
    while True:
        pairs = edges.select("a", "b").union(edges.select("b", "a"))
        roots = pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        roots = write_table(roots.select("node", F.least("node", "root").alias("root")), "roots")
        while True:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
            jumped = write_table(roots.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "roots")
            roots = jumped.select("node", "root")
            if not jumped.filter("moved").limit(1).count():
                break
        if labels is None:
            labels = roots.select("node", F.col("root").alias("component"))
        else:
            up = roots.select(F.col("node").alias("component"), F.col("root").alias("up"))
            labels = labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
            labels = write_table(labels, "labels")
        of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = edges.join(of_a, "a").join(of_b, "b").filter("ra <> rb")
        left = left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = write_table(left, "edges")
        if not edges.limit(1).count():
            return labels
