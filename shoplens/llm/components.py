"""Connected components of an edge table, with DataFrame operations.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): each step hangs the neighbours of
a node on the smallest of them. Minima are map-side-combined aggregates that
are joined back, so a node with many neighbours is never gathered in one task.
Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """(a, b) with a > b -> the same connectivity, hung on the minima."""
    if large:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        out = sides.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        hung = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = hung.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``: root is the smallest
    node of its component. Loops, repeated and reversed edges do no harm;
    nodes without an edge to another node are not listed."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .where("a > b").distinct(), "components")
    while True:
        # done when each node hangs on one other, which hangs on none
        several = now.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("x")).where("m < x").select("a")
        hanging = now.select(F.col("b").alias("a")).join(now.select("a"), "a", "left_semi")
        if several.unionByName(hanging).isEmpty():
            break
        now = materialize(_star(_star(now, True), False), "components")
    roots = now.select(F.col("b").alias("root")).distinct()
    return (now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(roots.select(F.col("root").alias("node"), "root")))
