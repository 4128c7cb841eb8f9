"""Comparison of several annotations as sets, and id maps between them."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chains as C
from ..session import stored
from .islands import merge_intervals
from .scans import BLOCK_BITS, running


def label_subsets(labels: list[str]) -> dict[int, str]:
    """Bit mask -> label names for every non-empty subset of labels."""
    out = {}
    for n in range(1, len(labels) + 1):
        for combo in combinations(range(len(labels)), n):
            out[sum(1 << i for i in combo)] = ",".join(labels[i] for i in combo)
    return out


def exclusive_sets(items: DataFrame, item: list[str], label: str, labels: list[str]) -> DataFrame:
    """(label_set, n): how many items occur in exactly the labels of each subset.

    One aggregate per item (bits of its labels, combined on the map side) and
    one per mask; subsets without items are listed with 0.
    """
    bit = reduce(lambda acc, i: acc.when(F.col(label) == labels[i], 1 << i), range(1, len(labels)), F.when(F.col(label) == labels[0], 1))
    masks = items.groupBy(*item).agg(F.bit_or(bit.cast("bigint")).alias("mask"))
    counts = masks.where("mask IS NOT NULL").groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    names = label_subsets(labels)
    spark = items.sparkSession
    frame = spark.createDataFrame([(m, s) for m, s in names.items()], "mask bigint, label_set string")
    return frame.join(counts, "mask", "left").select("label_set", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def exon_intron_items(tx: DataFrame) -> DataFrame:
    """(kind, item, label): exon and intron strings of every transcript, all introns included."""
    where = F.concat(F.col("seqid"), F.col("strand"))
    as_item = lambda kind, arr: tx.select(
        F.lit(kind).alias("kind"), where.alias("w"), "label", F.explode(arr).alias("x")
    ).select("kind", F.concat("w", F.concat_ws("-", "x.s", "x.e")).alias("item"), "label")
    return as_item("exon", F.col("chain")).unionByName(as_item("intron", C.introns(F.col("chain"))))


def coverage_cells(iv: DataFrame, keys: list[str], label: str, labels: list[str], s: str = "s", e: str = "e") -> DataFrame:
    """(keys, s, e, mask): the axis cut at every border, with the labels that cover each piece.

    Intervals are merged per label; then each label is either on or off, so a
    running sum of +bit at starts and -bit after ends is the mask itself.
    """
    bit = reduce(lambda acc, i: acc.when(F.col(label) == labels[i], 1 << i), range(1, len(labels)), F.when(F.col(label) == labels[0], 1))
    merged = merge_intervals(iv, [*keys, label], s, e).withColumn("_bit", bit.cast("bigint"))
    steps = merged.select(*keys, F.col(s).alias("_p"), F.col("_bit").alias("_d")).unionByName(
        merged.select(*keys, (F.col(e) + 1).alias("_p"), (-F.col("_bit")).alias("_d"))
    )
    points = stored(steps.groupBy(*keys, "_p").agg(F.sum("_d").alias("_d")).withColumn("_q", F.col("_p")))
    on = running(points, keys, "_p", {"mask": ("_d", "sum")}, inclusive=True)
    nxt = running(on, keys, "_p", {"_next": ("_q", "min")}, reverse=True)
    return nxt.where("mask > 0").select(*keys, F.col("_p").alias(s), (F.col("_next") - 1).alias(e), F.col("mask").cast("bigint").alias("mask"))


#: Positions of a tile are the bits of one word.
TILE_BITS = 6
#: Up to this many labels every combination has a column of its own.
TILE_LABELS = 6


def _label_tiles(iv: DataFrame, keys: list[str], label: str, labels: list[str]) -> DataFrame:
    """(keys, _t, _w0, _d0, ...): a row for each tile of 64 positions in which an interval starts or ends, or a whole cover begins.

    ``_w`` has the covered positions of each label as bits.  Tiles inside a longer interval are no rows: ``_d``
    is +1 where they begin and -1 behind them.
    """
    a, b = F.shiftright("s", TILE_BITS), F.shiftright("e", TILE_BITS)
    bit = lambda c: F.col(c).bitwiseAND(F.lit((1 << TILE_BITS) - 1)).cast("int")
    head = F.call_function("shiftleft", F.lit(-1).cast("bigint"), bit("s"))
    tail = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), F.lit((1 << TILE_BITS) - 1) - bit("e"))
    part = lambda t, w, d: F.struct(t.alias("t"), w.alias("w"), F.lit(d).cast("bigint").alias("d"))
    none = F.lit(0).cast("bigint")
    parts = (
        F.when(a == b, F.array(part(a, head.bitwiseAND(tail), 0)))
        .when(a + 1 == b, F.array(part(a, head, 0), part(b, tail, 0)))
        .otherwise(F.array(part(a, head, 0), part(a + 1, none, 1), part(b, tail, -1)))
    )
    whole = iv.select(*keys, label, F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"))
    whole = whole.where(F.col(label).isin(labels) & (F.col("s") <= F.col("e"))).dropna(subset=keys)
    cut = whole.select(*keys, label, F.explode(parts).alias("x")).select(*keys, label, F.col("x.t").alias("_t"), "x.w", "x.d")
    of = lambda i, c: F.when(F.col(label) == labels[i], F.col(c))
    return cut.groupBy(*keys, "_t").agg(
        *[F.coalesce(F.bit_or(of(i, "w")), none).alias(f"_w{i}") for i in range(len(labels))],
        *[F.coalesce(F.sum(of(i, "d")), none).alias(f"_d{i}") for i in range(len(labels))],
    )


def venn_bases(iv: DataFrame, keys: list[str], label: str, labels: list[str]) -> DataFrame:
    """(keys, mask, bases): covered bases of each label combination.

    Bits of tiles are combined on the map side, so a task sorts one row for 64 positions and not one for each border.
    One blocked scan counts the intervals that cover tiles whole.  More than 6 labels, and intervals without an end,
    go by cells.
    """
    if len(labels) > TILE_LABELS or iv.where("e IS NULL").head(1):
        cells = coverage_cells(iv, keys, label, labels)
        return cells.groupBy(*keys, "mask").agg(F.sum(F.col("e") - F.col("s") + 1).alias("bases"))
    n = range(len(labels))
    tiles = stored(_label_tiles(iv, keys, label, labels)).withColumn("_q", F.col("_t"))
    specs = {"_before": ("_q", "max")} | {f"_on{i}": (f"_d{i}", "sum") for i in n}
    seen = running(tiles, keys, "_t", specs, bits=BLOCK_BITS - TILE_BITS)
    on = [F.coalesce(f"_on{i}", F.lit(0)) for i in n]  # before the tile; tiles between two rows are covered by these
    words = [F.when(on[i] + F.col(f"_d{i}") > 0, F.lit(-1).cast("bigint")).otherwise(F.col(f"_w{i}")) for i in n]
    gap = reduce(lambda x, y: x.bitwiseOR(y), [F.when(on[i] > 0, F.lit(1 << i)).otherwise(0) for i in n])
    between = F.coalesce(F.col("_t") - F.col("_before") - 1, F.lit(0))
    seen = seen.select(*keys, gap.alias("_gap"), (between * (1 << TILE_BITS)).alias("_long"), *[w.alias(f"_c{i}") for i, w in enumerate(words)])
    masks = range(1, 1 << len(labels))
    cell = lambda m: reduce(
        lambda x, y: x.bitwiseAND(y), [F.col(f"_c{i}") if m >> i & 1 else F.bitwise_not(f"_c{i}") for i in n]
    )
    bases = [F.sum(F.bit_count(cell(m)) + F.when(F.col("_gap") == m, F.col("_long")).otherwise(0)) for m in masks]
    wide = seen.groupBy(*keys).agg(*[x.alias(f"_m{m}") for m, x in zip(masks, bases, strict=True)])
    rows = F.array(*[F.struct(F.lit(m).cast("bigint").alias("mask"), F.col(f"_m{m}").alias("bases")) for m in masks])
    return wide.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.mask", "x.bases").where("bases > 0")


def cell_scores(cells: DataFrame, track: DataFrame, keys: list[str]) -> DataFrame:
    """(mask, n, mean, lo, hi): value runs (keys, s, e, value) averaged over the cells of each mask.

    ``lo`` and ``hi`` start at 0; the mean is weighted by the shared bases.
    """
    from .ranges import overlap_join

    p = overlap_join(cells, track, keys, "s", "e")
    n = F.least("l_e", "r_e") - F.greatest("l_s", "r_s") + 1
    return p.withColumn("n", n).groupBy(F.col("l_mask").alias("mask")).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("r_value") * F.col("n")) / F.sum("n")).alias("mean"),
        F.least(F.lit(0.0), F.min("r_value")).alias("lo"),
        F.greatest(F.lit(0.0), F.max("r_value")).alias("hi"),
    )


def id_map(items: DataFrame, item: list[str], label: str, labels: list[str]) -> DataFrame:
    """One row per item with the smallest id of each label, NULL where a label lacks it.

    The same rows come out of a chain of full outer joins on the item; one
    aggregate needs a single shuffle and no row multiplication.
    """
    aggs = [F.min(F.when(F.col(label) == name, F.col("tid"))).alias(f"id_{name}") for name in labels]
    return items.groupBy(*item).agg(*aggs)


def outer_chain(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer joins in turn, for tables whose keys are unique per table."""
    return reduce(lambda a, b: a.join(b, on, "full"), frames)


def append_unseen(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """``first`` plus the rows of ``second`` whose key is new, without copies."""
    fresh = second.join(first.select(key).distinct(), key, "left_anti")
    return first.unionByName(fresh.select(first.columns)).distinct()
