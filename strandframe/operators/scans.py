"""Running aggregates along an axis, without one task per axis.

A plain ``Window.partitionBy(axis)`` puts a whole axis into one task, and a
single axis may hold a third of all rows.  Here the axis is cut into blocks of
``2**bits`` positions.  Windows run inside a block; what a block inherits
from the blocks before it comes from a second window over one row per block.
With the default of 2**20 positions a whole axis of 10**12 positions has about
a million block rows, so the second window stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_BITS = 20


def block_of(pos: Column, bits: int = BLOCK_BITS) -> Column:
    return F.shiftright(pos, bits)


def _merge(how: str, a: Column, b: Column) -> Column:
    if how == "max":
        return F.greatest(a, b)
    if how == "min":
        return F.least(a, b)
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


_AGG = {"max": F.max, "min": F.min, "sum": F.sum}


def running(
    df: DataFrame,
    keys: list[str],
    pos: str,
    specs: dict[str, tuple[str, str]],
    *,
    reverse: bool = False,
    inclusive: bool = False,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Add running aggregates over ``pos`` per ``keys``.

    ``df`` holds one row per (keys, pos).  ``specs`` maps the new column to
    (source column, "max" | "min" | "sum").  The frame excludes the current
    row unless ``inclusive``; ``reverse`` runs from high to low positions.
    """
    src = df.withColumn("_blk", block_of(F.col(pos), bits))
    order = F.col(pos).desc() if reverse else F.col(pos).asc()
    inner = W.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(
        W.unboundedPreceding, 0 if inclusive else -1
    )
    local = src
    for out, (col, how) in specs.items():
        local = local.withColumn(out, _AGG[how](col).over(inner))

    # block totals come from the same shuffled blocks, so the input is read once
    whole = W.partitionBy(*keys, "_blk").orderBy(order)
    sums = src.withColumn("_last", F.lead(F.lit(1)).over(whole).isNull())
    for out, (col, how) in specs.items():
        sums = sums.withColumn(f"_t_{out}", _AGG[how](col).over(whole.rowsBetween(W.unboundedPreceding, 0)))
    border = F.col("_blk").desc() if reverse else F.col("_blk").asc()
    outer = W.partitionBy(*keys).orderBy(border).rowsBetween(W.unboundedPreceding, -1)
    carry = sums.where("_last").select(
        *keys,
        "_blk",
        *[_AGG[how](f"_t_{out}").over(outer).alias(f"_c_{out}") for out, (_, how) in specs.items()],
    )
    # a key of one block inherits nothing, so with many small keys next to nothing is left to join
    carry = carry.where(" OR ".join(f"_c_{out} IS NOT NULL" for out in specs))
    joined = local.join(carry, [*keys, "_blk"], "left")
    for out, (_, how) in specs.items():
        joined = joined.withColumn(out, _merge(how, F.col(out), F.col(f"_c_{out}")))
    return joined.drop("_blk", *[f"_c_{o}" for o in specs])


def running_in_order(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    ties: list[str],
    specs: dict[str, tuple[str, str]],
    *,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Inclusive running aggregates per ``keys`` in the order (order..., ties...).

    ``order`` holds integer columns, a leading ``-`` reverses one.  Each of
    them is one blocked scan over aggregated positions, so a key that owns a
    third of all rows is still spread out; only rows equal in all of ``order``
    meet in one window.
    """
    if not order:
        w = W.partitionBy(*keys).orderBy(*ties).rowsBetween(W.unboundedPreceding, 0)
        for out, (col, how) in specs.items():
            df = df.withColumn(out, _AGG[how](col).over(w))
        return df
    pos, reverse = order[0].lstrip("-"), order[0].startswith("-")
    totals = df.groupBy(*keys, pos).agg(*[_AGG[how](col).alias(f"_v_{out}") for out, (col, how) in specs.items()])
    base = running(
        totals, keys, pos, {f"_b_{out}": (f"_v_{out}", how) for out, (_, how) in specs.items()}, reverse=reverse, bits=bits
    ).drop(*[f"_v_{o}" for o in specs])
    inner = running_in_order(df, [*keys, pos], order[1:], ties, specs, bits=bits).join(base, [*keys, pos])
    for out, (_, how) in specs.items():
        inner = inner.withColumn(out, _merge(how, F.col(out), F.col(f"_b_{out}")))
    return inner.drop(*[f"_b_{o}" for o in specs])


def numbered(
    df: DataFrame, keys: list[str], pos: str | list[str], ties: list[str], out: str, *, bits: int = BLOCK_BITS
) -> DataFrame:
    """Row numbers (from 1) per ``keys`` in the order (pos, ties)."""
    order = [pos] if isinstance(pos, str) else pos
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_in_order(one, keys, order, ties, {out: ("_one", "sum")}, bits=bits).drop("_one")
