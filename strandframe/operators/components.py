"""Connected components of a large edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


#: Edges of a node from which it is a hub; it grows with the edges, so there are never more than HUB_ROWS hubs.
HUB, HUB_ROWS = 64, 2000


def _star(edges: DataFrame, large: bool, limit: int | None) -> DataFrame:
    """One star step over edges (u, v) with u > v: hang neighbours on the smallest one.

    Nodes with over ``limit`` edges get their smallest neighbour by a broadcast of at most ``HUB_ROWS`` rows, so their edges
    stay where they are instead of meeting in one task.
    """
    if large:
        ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = edges.select(F.explode(ways).alias("w")).select("w.u", "w.v")
    else:
        both = edges
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    if limit is None:
        joined = both.join(low, "u")
    else:
        hubs = F.broadcast(low.where(F.col("n") > limit))
        joined = both.join(hubs, "u").unionByName(both.join(hubs, "u", "left_anti").join(low.where(F.col("n") <= limit), "u"))
    joined = joined.withColumn("m", F.least("u", "m"))
    if large:
        return joined.where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v"))
    ways = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    out = joined.select(F.explode(ways).alias("w")).select("w.u", "w.v")
    return out.where("u != v").distinct()


def _state(edges: DataFrame) -> tuple[bool, int | None]:
    """Whether some node does not hang directly on a root yet, and the limit for hubs if there are any; one aggregate."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = edges.select(F.explode(ends).alias("x")).groupBy("x.node").agg(F.sum("x.up").alias("up"), F.sum("x.down").alias("down"))
    loose = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))
    r = per.agg(F.max(loose).alias("loose"), F.max(F.col("up") + F.col("down")).alias("widest"), F.sum("up").alias("n")).first()
    limit = max(HUB, 2 * (r.n or 0) // HUB_ROWS)
    return bool(r.loose), limit if (r.widest or 0) > limit else None


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): component is the smallest node id reachable from node.

    Only nodes that appear in an edge are listed; an edge from a node to
    itself lists it on its own.  Alternating large-star and small-star steps
    need few rounds even for long paths and run to the fixed point.  The
    smallest neighbour is a map-side combined aggregate and hubs are joined
    by broadcast, so a node with very many edges is no single task; each
    round is checkpointed to reliable storage.
    """
    pair = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    pair = cut_lineage(pair)
    nodes = pair.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    cur = cut_lineage(pair.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    loose, limit = _state(cur)
    while loose:
        cur = cut_lineage(_star(_star(cur, True, limit), False, limit))
        loose, limit = _state(cur)
    return nodes.join(cur.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
