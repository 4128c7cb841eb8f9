"""Shards by rendezvous hashing: every shard bids for a row, the highest bid takes it.

The bid depends on the row's key and the shard alone (the first 48 bits of an MD5 of both, as a number u in (0, 1)); with
weights, the smallest -ln(u) / weight wins, which gives each shard rows in proportion to its weight.  A new shard changes no
other bid, so rows move only into it; a shard that leaves gives up its own rows only.

Numbers within a shard follow (key, checksum, size).  They come from one range exchange over narrow rows: a task holds a
contiguous stretch of that order, so a row's number is its place in the stretch plus the sizes of earlier stretches of its
shard.  Ties are split by the place in the scan; a key that a third of all rows share is cut over tasks like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored

#: Bits of a bid.
BITS = 48


def bid(key: Column, shard: Column, weight: Column) -> Column:
    """What a shard offers for a key: smaller is better."""
    drawn = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary")), 1, BITS // 4), 16, 10).cast("double")
    return -F.log((drawn + 0.5) / float(1 << BITS)) / weight


def _best(key: Column, shards: dict[int, float]) -> Column:
    if not shards or min(shards.values()) <= 0:
        raise ValueError("weights must be positive, and there must be a shard")
    entries = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in sorted(shards.items())])
    return F.array_min(F.transform(entries, lambda e: F.struct(bid(key, e["shard"], e["weight"]).alias("bid"), e["shard"].alias("shard"))))


def key_text(id_col: str) -> Column:
    """A row's key as text; a null is empty."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def shard_of(key: Column, shards: dict[int, float], added: dict[int, float] | None = None) -> Column:
    """struct(shard, grown): the shard among ``shards``, and the one once ``added`` ones bid, too."""
    best = _best(key, shards)
    if not added:
        return F.struct(best["shard"].alias("shard"), best["shard"].alias("grown"))
    return F.transform(
        F.array(F.struct(best.alias("old"), _best(key, added).alias("new"))),
        lambda b: F.struct(b["old"]["shard"].alias("shard"), F.least(b["old"], b["new"])["shard"].alias("grown")),
    )[0]


def assigned(docs: DataFrame, shards: dict[int, float], added: dict[int, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length plus 8, a null text has no bytes.  ``slot`` counts from 0 without gaps in each shard, in the
    order of id (nulls first), checksum and size; rows that agree in all of them follow the order of the scan.  Equal ids,
    null ids among them, share a shard.  Other columns are ignored; an empty table gives no row.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    to = shard_of(key_text(id_col), shards, added)
    narrow = docs.select(F.col(id_col).alias("id"), (F.length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("crc"), to.alias("to"), F.monotonically_increasing_id().alias("place"))
    rows = stored(narrow.select("id", "size", "crc", "place", "to.*"))
    order = ["shard", "id", "crc", "size", "place"]
    ranked = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranked = stored(ranked.drop("place").withColumn("stretch", F.shiftright("at", 33)))
    sizes = ranked.groupBy("shard", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("shard", "stretch", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return ranked.join(starts, ["shard", "stretch"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        (F.col("at") + F.col("shift")).alias("slot"), F.col("grown").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, shards: dict[int, float], folder: str, id_col: str = "doc_id", rows_per_file: int = 1 << 20) -> None:
    """Write all columns of ``docs`` as Parquet, a folder ``_shard=s`` for each shard, its rows ordered by id within and across files.

    The column ``_shard`` must be free.
    """
    if "_shard" in docs.columns:
        raise ValueError("the column _shard is taken")
    rows = docs.withColumn("_shard", shard_of(key_text(id_col), shards)["shard"])
    rows = rows.repartitionByRange("_shard", id_col, F.xxhash64(*[c for c, t in docs.dtypes if not t.startswith("map")])).sortWithinPartitions("_shard", id_col)
    rows.write.option("maxRecordsPerFile", rows_per_file).partitionBy("_shard").parquet(folder)
