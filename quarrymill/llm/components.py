"""Connected components of a graph of long ids, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the least id of the node's component) for every node of edges (a, b); no edges give no rows.

    Each round points every node at its least neighbour or itself, follows the pointers to their ends, and replaces edges
    by edges between ends; pointers only go down, so they have ends. All tables are staged; a node with very many edges
    skews only joins against a table with one row per node, which Spark splits.
    """
    edges = stage(edges.select("a", "b").where("a <> b").distinct(), "edges")
    found: DataFrame | None = None
    while found is None or not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = stage(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("least")).select("v", F.least("v", "least").alias("p")), "up")
        while True:
            jump = up.join(up.select(F.col("v").alias("w"), F.col("p").alias("q")), F.col("p") == F.col("w"))
            jump = stage(jump.select("v", F.col("q").alias("p"), (F.col("q") < F.col("p")).alias("moved")), "jump")
            up = jump.select("v", "p")
            if jump.where("moved").isEmpty():
                break
        found = up.select(F.col("v").alias("node"), F.col("p").alias("root")) if found is None else stage(
            found.join(up, F.col("root") == F.col("v"), "left").select("node", F.coalesce("p", "root").alias("root")), "found"
        )
        ends = edges.join(up, F.col("a") == F.col("v")).select(F.col("p").alias("a"), "b").join(up, F.col("b") == F.col("v")).select("a", F.col("p").alias("b"))
        edges = stage(ends.where("a <> b").distinct(), "edges")
    return found
