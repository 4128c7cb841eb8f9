"""Range joins: overlap, containment and point lookup.

Spark has no range-join operator, and an inequality-only join compares every
pair of rows.  These joins turn the range test into an equality on
(keys, level, bin).  Every interval is stored once, at the smallest level
whose bin is at least as wide as the interval, so it covers at most two bins;
a point looks into one bin per level.  Two closed intervals overlap exactly
when one of the two starts lies inside the other, so every pair is found
exactly once and no pair list has to be made distinct afterwards.  Long and
short intervals can be mixed freely; bins with many rows are ordinary join
partitions, which adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVELS = (10, 16, 22, 28)


def _stored(df: DataFrame, s: Column, e: Column, levels: tuple[int, ...]) -> DataFrame:
    level = F.lit(levels[-1])
    for bits in reversed(levels[:-1]):
        level = F.when(e - s < F.lit(1 << bits), F.lit(bits)).otherwise(level)
    first = last = None
    for bits in levels:
        lo, hi = F.shiftright(s, bits), F.shiftright(e, bits)
        hit = F.col("_lv") == bits
        first = F.when(hit, lo) if first is None else first.when(hit, lo)
        last = F.when(hit, hi) if last is None else last.when(hit, hi)
    return df.withColumn("_lv", level).withColumn("_bin", F.explode(F.sequence(first, last)))


def _probed(df: DataFrame, p: Column, levels: tuple[int, ...]) -> DataFrame:
    slots = F.array(
        *[F.struct(F.lit(b).alias("_lv"), F.shiftright(p, b).alias("_bin")) for b in levels]
    )
    return df.withColumn("_slot", F.explode(slots)).select(
        *df.columns, F.col("_slot._lv").alias("_lv"), F.col("_slot._bin").alias("_bin")
    )


def _prefixed(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    return df.select(*[F.col(k) for k in keys], *[F.col(c).alias(f"{tag}{c}") for c in df.columns if c not in keys])


def point_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    point: str,
    s: str,
    e: str,
    *,
    extra: Column | None = None,
    levels: tuple[int, ...] = LEVELS,
) -> DataFrame:
    """Pairs (point row, interval row) with ``s <= point <= e`` and equal keys.

    Column names of the two inputs must differ outside ``keys``.
    """
    left = _probed(points, F.col(point), levels)
    right = _stored(intervals, F.col(s), F.col(e), levels)
    cond = (F.col(point) >= F.col(s)) & (F.col(point) <= F.col(e))
    if extra is not None:
        cond = cond & extra
    return left.join(right, [*keys, "_lv", "_bin"]).where(cond).drop("_lv", "_bin")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    s: str = "start",
    e: str = "end",
    *,
    extra: Column | None = None,
    levels: tuple[int, ...] = LEVELS,
) -> DataFrame:
    """All pairs of ``left`` and ``right`` rows whose closed intervals overlap.

    Columns outside ``keys`` come back as ``l_*`` and ``r_*``.
    """
    a, b = _prefixed(left, keys, "l_"), _prefixed(right, keys, "r_")
    first = point_join(b, a, keys, f"r_{s}", f"l_{s}", f"l_{e}", extra=extra, levels=levels)
    strictly = F.col(f"l_{s}") > F.col(f"r_{s}")
    second = point_join(
        a, b, keys, f"l_{s}", f"r_{s}", f"r_{e}",
        extra=strictly if extra is None else strictly & extra, levels=levels,
    )
    cols = [*keys, *[c for c in a.columns if c not in keys], *[c for c in b.columns if c not in keys]]
    return first.select(*cols).unionByName(second.select(*cols))


def self_overlap(
    df: DataFrame,
    keys: list[str],
    id_col: str,
    s: str = "start",
    e: str = "end",
    *,
    levels: tuple[int, ...] = LEVELS,
) -> DataFrame:
    """Unordered overlapping pairs of one table; ``l_`` is first by (start, id)."""
    a, b = _prefixed(df, keys, "l_"), _prefixed(df, keys, "r_")
    first = (F.col(f"l_{s}") < F.col(f"r_{s}")) | (
        (F.col(f"l_{s}") == F.col(f"r_{s}")) & (F.col(f"l_{id_col}") < F.col(f"r_{id_col}"))
    )
    return point_join(b, a, keys, f"r_{s}", f"l_{s}", f"l_{e}", extra=first, levels=levels)


def contained_join(
    inner: DataFrame,
    outer: DataFrame,
    keys: list[str],
    s: str = "s",
    e: str = "e",
    *,
    levels: tuple[int, ...] = LEVELS,
) -> DataFrame:
    """Pairs where the ``inner`` interval (``l_*``) lies inside the ``outer`` one (``r_*``)."""
    a, b = _prefixed(inner, keys, "l_"), _prefixed(outer, keys, "r_")
    return point_join(
        a, b, keys, f"l_{s}", f"r_{s}", f"r_{e}", extra=F.col(f"l_{e}") <= F.col(f"r_{e}"), levels=levels
    )


def containing(
    inner: DataFrame, outer: DataFrame, keys: list[str], s: str = "s", e: str = "e"
) -> DataFrame:
    """Add to each ``inner`` row whether any ``outer`` interval contains it (``is_contained``).

    Existence needs no pairs: an interval lies inside some outer interval
    exactly when the largest outer end among starts <= s reaches e.  That is
    a running maximum, linear in the input however crowded the axis is.
    """
    from .scans import running

    starts = outer.groupBy(*keys, F.col(s).alias("_p")).agg(F.max(e).alias("_m"))
    probes = inner.select(*keys, F.col(s).alias("_p")).withColumn("_m", F.lit(None).cast("bigint"))
    axis = starts.unionByName(probes).groupBy(*keys, "_p").agg(F.max("_m").alias("_m"))
    reach = running(axis, keys, "_p", {"_reach": ("_m", "max")}, inclusive=True).select(
        *keys, F.col("_p").alias(s), "_reach"
    )
    return (
        inner.join(reach, [*keys, s], "left")
        .withColumn("is_contained", F.coalesce(F.col("_reach") >= F.col(e), F.lit(False)))
        .drop("_reach")
    )


def holding(outer: DataFrame, inner: DataFrame, keys: list[str], s: str = "s", e: str = "e") -> DataFrame:
    """Add to each ``outer`` row whether it contains any ``inner`` interval (``holds_any``).

    An outer interval holds one exactly when the smallest inner end among
    inner starts >= s is at most e.
    """
    from .scans import running

    starts = inner.groupBy(*keys, F.col(s).alias("_p")).agg(F.min(e).alias("_m"))
    probes = outer.select(*keys, F.col(s).alias("_p")).withColumn("_m", F.lit(None).cast("bigint"))
    axis = starts.unionByName(probes).groupBy(*keys, "_p").agg(F.min("_m").alias("_m"))
    reach = running(axis, keys, "_p", {"_reach": ("_m", "min")}, inclusive=True, reverse=True).select(
        *keys, F.col("_p").alias(s), "_reach"
    )
    return (
        outer.join(reach, [*keys, s], "left")
        .withColumn("holds_any", F.coalesce(F.col("_reach") <= F.col(e), F.lit(False)))
        .drop("_reach")
    )


def nearest(
    queries: DataFrame,
    sites: DataFrame,
    keys: list[str],
    q_pos: str,
    site_pos: str,
    site_id: str,
    *,
    out: str,
) -> DataFrame:
    """Nearest site at or before and at or after each query position.

    Adds ``{out}_le``/``{out}_le_id`` and ``{out}_ge``/``{out}_ge_id``; of sites
    on one position the smallest id is used.  One ordered pass per block of positions looks both ways, no pairs; only keys with
    several blocks hand anything on.
    """
    from .scans import block_of

    pts = sites.groupBy(*keys, F.col(site_pos).alias("_p")).agg(F.min(site_id).alias("_id"))
    pts = pts.withColumn("_site", F.struct(F.col("_p").alias("p"), F.col("_id").alias("id"))).drop("_id")
    ask = queries.select(*keys, F.col(q_pos).alias("_p")).withColumn("_site", F.lit(None).cast(pts.schema["_site"].dataType))
    axis = pts.unionByName(ask).groupBy(*keys, "_p").agg(F.max("_site").alias("_site"))
    axis = axis.withColumn("_blk", block_of(F.col("_p")))
    w = W.partitionBy(*keys, "_blk").orderBy("_p")
    local = axis.withColumn("_le", F.max("_site").over(w.rowsBetween(W.unboundedPreceding, 0)))
    local = local.withColumn("_ge", F.min("_site").over(w.rowsBetween(0, W.unboundedFollowing)))
    blocks = axis.groupBy(*keys, "_blk").agg(F.min("_site").alias("_lo"), F.max("_site").alias("_hi"))
    wide = W.partitionBy(*keys).orderBy("_blk")
    before = F.max("_hi").over(wide.rowsBetween(W.unboundedPreceding, -1)).alias("_cle")
    after = F.min("_lo").over(wide.rowsBetween(1, W.unboundedFollowing)).alias("_cge")
    carry = blocks.select(*keys, "_blk", before, after).where("_cle IS NOT NULL OR _cge IS NOT NULL")
    # sites of the own block are nearer than any handed on
    both = local.join(carry, [*keys, "_blk"], "left").withColumn("_le", F.coalesce("_le", "_cle")).withColumn("_ge", F.coalesce("_ge", "_cge"))
    found = both.select(
        *keys,
        F.col("_p").alias(q_pos),
        F.col("_le.p").alias(f"{out}_le"),
        F.col("_le.id").alias(f"{out}_le_id"),
        F.col("_ge.p").alias(f"{out}_ge"),
        F.col("_ge.id").alias(f"{out}_ge_id"),
    )
    return queries.join(found, [*keys, q_pos], "left")
