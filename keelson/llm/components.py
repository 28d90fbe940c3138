"""Connected components of an edge table by alternating large and small stars.

Every round is two joins and aggregations written to the shared checkpoint folder.  Minima are combined
before each shuffle and written before they are joined back, so Spark can split the join of a node with
a large share of all edges.  No node's neighbours are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect the larger (large) or the not larger (small) neighbours of every node to its least neighbour."""
    if large:
        around = edges.select(F.col("u").alias("n"), F.col("v").alias("x")).unionAll(edges.select(F.col("v").alias("n"), F.col("u").alias("x")))
    else:
        around = edges.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("x"))
    least = around.groupBy("n").agg(F.min("x").alias("x"))
    least = materialize(least.select(F.col("n").alias("at"), F.least("n", "x").alias("m")), "star-least")
    linked = around.join(least, F.col("n") == F.col("at"))
    if large:
        return linked.where("x > n").select(F.col("x").alias("u"), F.col("m").alias("v"))
    return linked.select(F.col("x").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(
        least.where("at <> m").select(F.col("at").alias("u"), F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v; any orderable type); component is the least node."""
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")

    def state(e):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = state(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        edges = materialize(_star(materialize(_star(edges, True).distinct(), "large-star"), False).distinct(), "small-star")
        now = state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
