"""Merging and bundling of intervals (gaps and islands).

``gap`` states when the next interval starts a new island, given the largest
end ``m`` seen so far: a new island starts where ``start > m + gap``.

* ``gap=0``   intervals that share a base join (closed overlap)
* ``gap=1``   adjacent intervals join as well
* ``gap=-1``  sharing only the border base is not enough (open overlap)

Work is split into blocks along the axis, see :mod:`.scans`: a crowded axis or
key is spread over many tasks, and copies are removed before any window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored
from .scans import BLOCK_BITS, block_of


def _local_runs(
    df: DataFrame, keys: list[str], s: str, e: str, gap: int, bits: int, extra: dict[str, Column] | None = None
) -> DataFrame:
    """Distinct starts with the start of their run inside the block.

    ``extra`` names further aggregates over the rows of each start.
    """
    # the null filter stands here, so both uses of this result share one shuffle
    known = F.col(s).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    starts = df.where(known).groupBy(*keys, block_of(F.col(s), bits).alias("_blk"), F.col(s).alias("_s")).agg(
        F.max(e).alias("_e"), *[agg.alias(name) for name, agg in (extra or {}).items()]
    )
    w = W.partitionBy(*keys, "_blk").orderBy("_s")
    seen = F.max("_e").over(w.rowsBetween(W.unboundedPreceding, -1))
    flagged = starts.withColumn("_new", seen.isNull() | (F.col("_s") > seen + gap))
    return flagged.withColumn(
        "_run",
        F.max(F.when(F.col("_new"), F.col("_s"))).over(w.rowsBetween(W.unboundedPreceding, 0)),
    ).drop("_new")


def _carry(runs: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Largest end and last island start before each block (only where there are earlier blocks)."""
    blocks = runs.groupBy(*keys, "_blk").agg(F.max("_e").alias("_be"), F.max("_run").alias("_bs"))
    w = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    return (
        blocks.withColumn("_ce", F.max("_be").over(w))
        .withColumn("_open", F.when(F.col("_ce").isNull() | (F.col("_bs") > F.col("_ce") + gap), F.col("_bs")))
        .withColumn("_cs", F.max("_open").over(w))
        .where(F.col("_ce").isNotNull())
        .select(*keys, "_blk", "_ce", "_cs")
    )


def _resolve(runs: DataFrame, keys: list[str], gap: int) -> DataFrame:
    inherited = F.col("_ce").isNotNull() & (F.col("_run") <= F.col("_ce") + gap)
    return (
        runs.join(_carry(runs, keys, gap), [*keys, "_blk"], "left")
        .withColumn("_isl", F.when(inherited, F.col("_cs")).otherwise(F.col("_run")))
        .drop("_ce", "_cs")
    )


def merge_intervals(
    df: DataFrame, keys: list[str], s: str = "s", e: str = "e", *, gap: int = 0, bits: int = BLOCK_BITS
) -> DataFrame:
    """Union of the intervals of each key as disjoint intervals (keys, s, e)."""
    runs = _local_runs(df, keys, s, e, gap, bits)
    local = runs.groupBy(*keys, "_blk", "_run").agg(F.max("_e").alias("_e"))
    return (
        _resolve(local, keys, gap)
        .groupBy(*keys, F.col("_isl").alias(s))
        .agg(F.max("_e").alias(e))
    )


def assign_islands(
    df: DataFrame,
    keys: list[str],
    s: str = "s",
    e: str = "e",
    *,
    gap: int = 0,
    out: str = "island",
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Add the start of the island each row belongs to (the island's id within its keys).

    ``df`` is read twice; pass a stored table if it is costly to compute.
    """
    runs = _resolve(_local_runs(df, keys, s, e, gap, bits), keys, gap)
    ids = runs.select(*keys, F.col("_s").alias(s), F.col("_isl").alias(out))
    return df.join(ids, [*keys, s])


def bundle_summary(tx: DataFrame, keys: list[str] = ["seqid", "strand"], *, gap: int = 0, bits: int = BLOCK_BITS) -> DataFrame:
    """One row per bundle of overlapping transcripts."""
    flag = F.col("is_template").cast("bigint") if "is_template" in tx.columns else F.lit(0).cast("bigint")
    slim = tx.select(*keys, F.col("start").alias("s"), F.col("end").alias("e"), F.lit(1).cast("bigint").alias("n"), flag.alias("t"))
    runs = _local_runs(slim, keys, "s", "e", gap, bits, {"_n": F.sum("n"), "_t": F.sum("t")})
    # one row per run; stored, so the blocks' borders are resolved without a second pass over the input
    local = stored(
        runs.groupBy(*keys, "_blk", "_run").agg(F.max("_e").alias("_e"), F.sum("_n").alias("_n"), F.sum("_t").alias("_t"))
    )
    return (
        _resolve(local, keys, gap)
        .groupBy(*keys, F.col("_isl").alias("bundle_start"))
        .agg(F.max("_e").alias("bundle_end"), F.sum("_n").alias("n_tx"), F.sum("_t").alias("n_templates"))
    )
