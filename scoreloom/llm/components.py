"""Connected components of an edge list in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.tables import written


def _roots(hooks: DataFrame) -> DataFrame:
    """(node, label) of a forest given as (node, label) with smaller labels: the last label that is reached, by doubling steps."""
    while True:
        up = hooks.select(F.col("node").alias("label"), F.col("label").alias("up"))
        moved = written(hooks.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"), F.col("up").isNotNull().alias("moved")))
        hooks = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return hooks


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, label): label is the smallest node reachable from ``node``; nodes without an edge to another
    node don't appear.

    Contraction: every node is hooked to its smallest neighbour below it, the trees that arise are shrunk to their roots,
    and the edges are rewritten between roots, without loops and repetitions. Every node that has an edge
    is hooked or hooked to, so a round at least halves the nodes, and edges only get fewer. A
    node with very many edges is met only by partial aggregates and by joins that adaptive execution can split. Every
    round is written to the shared folder; nothing but flags reach the driver.
    """
    ordered = lambda a, b: (F.greatest(a, b).alias("node"), F.least(a, b).alias("other"))
    graph = written(edges.select(*ordered(left, right)).where("node != other").distinct())
    levels = []
    while not graph.isEmpty():
        label = _roots(written(graph.groupBy("node").agg(F.min("other").alias("label"))))
        levels.append(label)
        above, below = label.withColumnRenamed("label", "a"), label.withColumnsRenamed({"node": "other", "label": "b"})
        graph = written(
            graph.join(above, "node").join(below, "other", "left").select(*ordered("a", F.coalesce("b", "other"))).where("node != other").distinct()
        )
    if not levels:
        return edges.select(F.col(left).alias("node"), F.col(left).alias("label")).limit(0)
    # Later rounds label the roots of the rounds before; each round is a fraction of the one before.
    found = levels[-1]
    for label in reversed(levels[:-1]):
        last = found.select(F.col("node").alias("label"), F.col("label").alias("last"))
        found = found.unionByName(label.join(last, "label", "left").select("node", F.coalesce("last", "label").alias("label")))
    found = written(found)
    return found.unionByName(found.select(F.col("label").alias("node"), "label").distinct())
