"""Connected components of a graph given as edges, by alternating large and small stars.

A large star links every larger neighbour of a node to the least node around it, a small star every smaller one.
Both are a grouping, combined before its shuffle, and a look-up of the least node. Nodes with more than a set share
of all edges (hubs) are few by that definition, whatever the graph: their least nodes are broadcast, so a hub's
edges stay where they are; all others are joined by a shuffle.

Nothing but two numbers a round reaches the driver; each round's edges are written, so a lost executor costs a part
of one round, and deleted when the next round's are there.

Defined cases: an edge with a null end is none; loops and repeated edges add nothing; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_path, stored


#: Up to so many edges a node's edges are no matter for one task, and there are no hubs.
FEW = 1 << 20


def _with_least(edges: DataFrame, around: DataFrame, hub: int | None) -> DataFrame:
    """(a, b, m): edges with the least node around a. `around` is what the least is taken from; a node with more
    than `hub` rows of it is a hub."""
    least = around.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    if hub is None:
        return edges.join(least.select("a", "m"), "a").select("a", "b", "m")
    hubs = least.where(F.col("n") > hub).select("a", F.col("m").alias("hub_m"))
    marked = edges.join(F.broadcast(hubs), "a", "left")
    others = marked.where("hub_m IS NULL").select("a", "b").join(least.where(F.col("n") <= hub).select("a", "m"), "a")
    return others.select("a", "b", "m").unionByName(marked.where("hub_m IS NOT NULL").select("a", "b", F.col("hub_m").alias("m")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", hubs: int = 4096) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node that can be reached. At most about
    `hubs` nodes are hubs, and at most that many rows are broadcast."""
    spark = edges.sparkSession
    path = shared_path(spark, "components-edges")
    e = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), path)
    state, n = None, e.count()
    while True:
        hub = 2 * n // hubs if n > FEW else None
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both.where("b > a"), both, hub)
        large = large.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = _with_least(large, large, hub)
        # every smaller neighbour hangs on the least one, and so does the node itself
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        before, path = path, shared_path(spark, "components-edges")
        e = stored(small.select("x.a", "x.b").where("a <> b").distinct(), path)
        discard(spark, before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, n = now, now[0]
    return e.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
