"""Values along an axis as runs (seqid, s, e, v), and their statistics over intervals, without a row for each base.

Sums come from prefix sums: two look-ups per interval.  Minimum and maximum come from a tree over the runs in order: a leaf
holds the values of 64 runs, an inner node the extremes of 64 nodes.  An interval needs a part of at most two nodes of each
level.  Runs must not overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .scans import numbered, running

#: Children of a node, as a power of two.
FAN_BITS = 6


def indexed_runs(runs: DataFrame) -> DataFrame:
    """Stored runs with rank (from 0 along the axis) and what stands up to their end: bases and total (sum of v over bases)."""
    size = F.col("e") - F.col("s") + 1
    rows = runs.where("v IS NOT NULL AND s <= e").select("seqid", "s", "e", "v", size.alias("_n"), (F.col("v") * size).alias("_t"))
    ranked = numbered(rows, ["seqid"], "s", [], "rank")
    summed = running(ranked, ["seqid"], "s", {"bases": ("_n", "sum"), "total": ("_t", "sum")}, inclusive=True)
    return stored(summed.select("seqid", "s", "e", "v", (F.col("rank") - 1).alias("rank"), "bases", "total"))


def extreme_tree(index: DataFrame) -> DataFrame:
    """(seqid, level, node, lo, hi): arrays of the smallest and largest values of a node's children, in order."""
    below = index.select("seqid", F.col("rank").alias("child"), F.col("v").alias("lo"), F.col("v").alias("hi"))
    levels = []
    while True:
        at = len(levels)
        kids = F.array_sort(F.collect_list(F.struct("child", "lo", "hi")))
        node = below.groupBy("seqid", F.shiftright("child", FAN_BITS).alias("node")).agg(kids.alias("k"), F.max("child").alias("last"))
        node = stored(node.select("seqid", F.lit(at).alias("level"), "node", F.transform("k", lambda x: x["lo"]).alias("lo"), F.transform("k", lambda x: x["hi"]).alias("hi")))
        levels.append(node)
        below = node.select("seqid", F.col("node").alias("child"), F.array_min("lo").alias("lo"), F.array_max("hi").alias("hi"))
        if not node.where("node > 0").head(1):  # one root for each sequence
            break
    tree = levels[0]
    for x in levels[1:]:
        tree = tree.unionByName(x)
    return tree


def _pieces(first: Column, last: Column, levels: int) -> Column:
    """Parts of nodes that make up the ranks first..last: array of (level, node, a, b), children a..b of a node.

    On each level the ragged ends are taken and what is left are whole nodes of the next level.
    """
    piece = "array<struct<level:int,node:bigint,a:int,b:int>>"
    low = (1 << FAN_BITS) - 1

    def step(acc: Column, level: Column) -> Column:
        i, j = acc["i"], acc["j"]
        ni, nj = F.shiftright(i, FAN_BITS), F.shiftright(j, FAN_BITS)
        ci, cj = i.bitwiseAND(F.lit(low)), j.bitwiseAND(F.lit(low))
        one = lambda n, a, b: F.struct(level.alias("level"), n.alias("node"), a.cast("int").alias("a"), b.cast("int").alias("b"))
        none = F.array().cast(piece)
        same = ni == nj
        left = F.when(~same & (ci > 0), F.array(one(ni, ci, F.lit(low)))).otherwise(none)
        right = F.when(~same & (cj < low), F.array(one(nj, F.lit(0), cj))).otherwise(none)
        got = F.when(i > j, none).when(same, F.array(one(ni, ci, cj))).otherwise(F.concat(left, right))
        done = (i > j) | same
        return F.struct(
            F.when(done, F.lit(1)).otherwise(F.when(ci > 0, ni + 1).otherwise(ni)).cast("bigint").alias("i"),
            F.when(done, F.lit(0)).otherwise(F.when(cj < low, nj - 1).otherwise(nj)).cast("bigint").alias("j"),
            F.concat(acc["out"], got).alias("out"),
        )

    state = F.struct(first.cast("bigint").alias("i"), last.cast("bigint").alias("j"), F.array().cast(piece).alias("out"))
    return F.aggregate(F.array(*[F.lit(k) for k in range(levels)]), state, step, lambda acc: acc["out"])


def interval_stats(intervals: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """(key, bases, share, total, mean, low, high) of each interval (key, seqid, start, end).

    ``bases`` are those with a value, ``share`` is their part of the interval, ``mean`` that over them.  Without any the last
    four are NULL.  Keys must be unique; overlapping intervals and copies are fine.
    """
    index = indexed_runs(runs)
    tree = stored(extreme_tree(index))
    depth = (tree.agg(F.max("level").alias("d")).first().d or 0) + 1

    run = index.select("seqid", F.col("s").alias("p"), F.struct("s", "e", "v", "rank", "bases", "total").alias("r"))
    spots = intervals.select("seqid", F.explode(F.array(F.col("start") - 1, F.col("end"))).alias("p")).distinct().withColumn("r", F.lit(None).cast(run.schema["r"].dataType))
    axis = run.unionByName(spots).groupBy("seqid", "p").agg(F.max("r").alias("r"))
    at = stored(running(axis, ["seqid"], "p", {"last": ("r", "max")}, inclusive=True).select("seqid", "p", "last"))
    left, right = (at.select("seqid", F.col("p").alias(n), F.col("last").alias(x)) for n, x in (("_p", "_l"), ("end", "_r")))
    rows = intervals.select(key, "seqid", "start", "end").withColumn("_p", F.col("start") - 1).join(left, ["seqid", "_p"]).join(right, ["seqid", "end"])

    def upto(r: Column, p: Column, what: str) -> Column:
        """What stands up to position p, if r is the last run that starts there or before."""
        over = F.greatest(r["e"] - p, F.lit(0))
        return F.coalesce(r[what] - over * (F.lit(1) if what == "bases" else r["v"]), F.lit(0))

    sums = {w: upto(F.col("_r"), F.col("end"), w) - upto(F.col("_l"), F.col("_p"), w) for w in ("bases", "total")}
    # the first run that reaches into the interval is the one before its start if that ends inside, else the next one
    first = F.when(F.col("_l").isNull(), 0).when(F.col("_l.e") >= F.col("start"), F.col("_l.rank")).otherwise(F.col("_l.rank") + 1)
    rows = stored(rows.select(key, "seqid", (F.col("end") - F.col("start") + 1).alias("n"), sums["bases"].alias("bases"), sums["total"].alias("total"),
                              first.cast("bigint").alias("i"), F.coalesce(F.col("_r.rank"), F.lit(-1)).alias("j")))
    # equal stretches of runs are asked once
    asked = rows.where("i <= j").select("seqid", "i", "j").distinct()
    parts = asked.select("seqid", "i", "j", F.explode(_pieces(F.col("i"), F.col("j"), depth)).alias("x")).select("seqid", "i", "j", "x.*")
    cut = lambda c: F.slice(c, F.col("a") + 1, F.col("b") - F.col("a") + 1)
    met = parts.join(tree, ["seqid", "level", "node"]).groupBy("seqid", "i", "j").agg(F.min(F.array_min(cut("lo"))).alias("low"), F.max(F.array_max(cut("hi"))).alias("high"))
    some = F.col("bases") > 0
    return rows.join(met, ["seqid", "i", "j"], "left").select(
        key, "bases", (F.col("bases") / F.col("n")).alias("share"), F.when(some, F.col("total")).alias("total"),
        F.when(some, F.col("total") / F.col("bases")).alias("mean"), F.when(some, F.col("low")).alias("low"), F.when(some, F.col("high")).alias("high"),
    )


def values_at(points: DataFrame, runs: DataFrame, pos: str) -> DataFrame:
    """Add ``v``: the value at each point (seqid, pos), NULL between runs."""
    index = runs.where("v IS NOT NULL AND s <= e").select("seqid", F.col("s").alias("p"), F.struct("s", "e", "v").alias("r"))
    spots = points.select("seqid", F.col(pos).alias("p")).distinct().withColumn("r", F.lit(None).cast(index.schema["r"].dataType))
    axis = index.unionByName(spots).groupBy("seqid", "p").agg(F.max("r").alias("r"))
    at = running(axis, ["seqid"], "p", {"last": ("r", "max")}, inclusive=True)
    found = at.select("seqid", F.col("p").alias(pos), F.when(F.col("last.e") >= F.col("p"), F.col("last.v")).alias("v"))
    return points.join(found, ["seqid", pos], "left")
