"""How far introns explain the transcripts of a gene, and intron-based selection.

Inputs: ``introns`` (gene, axis, s, e, cov, kind) with one row per gene and
intron, and ``members`` (gene, tid, axis, s, e) with one row per transcript
and intron, and ``expression`` (gene, tid, tpm).  kind: -1 false, 0 ambiguous,
1 good, 2 known.  Coverage and tpm are integers (scale them beforehand).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .pairs import AXIS
from .scans import running_in_order

FALSE, AMBIGUOUS, GOOD, KNOWN = -1, 0, 1, 2


def explanation_curve(introns: DataFrame) -> DataFrame:
    """Introns of each gene by falling coverage with cumulative shares (percent)."""
    good = introns.where(F.col("kind") != FALSE).withColumn("_one", F.lit(1).cast("bigint"))
    total = good.groupBy("gene").agg(F.sum("cov").alias("total"), F.count(F.lit(1)).alias("n"))
    ranked = running_in_order(good, ["gene"], ["-cov", "s"], ["e", *AXIS], {"rank": ("_one", "sum"), "cum": ("cov", "sum")})
    return ranked.join(total, "gene").select(
        "gene", *AXIS, "s", "e", "cov", "rank",
        (F.col("rank") * 100 / F.col("n")).alias("introns_pct"),
        (F.col("cov") * 100 / F.col("total")).alias("cov_pct"),
        (F.col("cum") * 100 / F.col("total")).alias("cum_cov_pct"),
    )


def _positions(introns: DataFrame, members: DataFrame, expression: DataFrame) -> DataFrame:
    """(gene, tid, tpm, pos): rank of the intron that completes each transcript."""
    curve = explanation_curve(introns).select("gene", *AXIS, "s", "e", "rank")
    joined = members.join(curve, ["gene", *AXIS, "s", "e"], "left")
    done = joined.groupBy("gene", "tid").agg(F.max("rank").alias("pos"), F.count_if(F.col("rank").isNull()).alias("missing"))
    return stored(done.where("missing = 0").drop("missing").join(expression, ["gene", "tid"]))


def completion(introns: DataFrame, members: DataFrame, expression: DataFrame) -> DataFrame:
    """When each transcript is complete, with the expression explained so far.

    Transcripts with a false intron never complete.
    """
    total = expression.join(members.select("gene", "tid").distinct(), ["gene", "tid"], "left_semi").groupBy("gene").agg(F.sum("tpm").alias("total"))
    pos = _positions(introns, members, expression)
    run = running_in_order(pos, ["gene"], ["pos"], ["tid"], {"cum": ("tpm", "sum")})
    return run.join(total, "gene").select(
        "gene", "tid", "pos", (F.col("tpm") * 100 / F.col("total")).alias("tpm_pct"), (F.col("cum") * 100 / F.col("total")).alias("cum_tpm_pct")
    )


def completion_ordered(introns: DataFrame, members: DataFrame, expression: DataFrame) -> DataFrame:
    """As :func:`completion`, but only by falling expression: a transcript waits for stronger ones.

    ``is_unique`` marks transcripts that bring an intron no earlier one used;
    known and ambiguous introns count as used from the start.
    """
    total = expression.join(members.select("gene", "tid").distinct(), ["gene", "tid"], "left_semi").groupBy("gene").agg(F.sum("tpm").alias("total"))
    pos = _positions(introns, members, expression)
    wait = stored(running_in_order(pos, ["gene"], ["-tpm"], ["tid"], {"wait": ("pos", "max")}))
    run = stored(running_in_order(wait, ["gene"], ["wait", "-tpm"], ["tid"], {"cum": ("tpm", "sum")}))
    open_introns = introns.where(F.col("kind") == GOOD).select("gene", *AXIS, "s", "e")
    first = (
        members.join(open_introns, ["gene", *AXIS, "s", "e"], "left_semi")
        .join(run.select("gene", "tid", "wait", "tpm"), ["gene", "tid"])
        .groupBy("gene", *AXIS, "s", "e")
        .agg(F.min(F.struct("wait", (-F.col("tpm")).alias("t"), "tid")).alias("f"))
        .select("gene", F.col("f.tid").alias("tid"))
        .distinct()
        .withColumn("u", F.lit(1))
    )
    return run.join(total, "gene").join(first, ["gene", "tid"], "left").select(
        "gene", "tid", F.col("wait").alias("pos"),
        (F.col("cum") * 100 / F.col("total")).alias("cum_tpm_pct"),
        F.coalesce("u", F.lit(0)).cast("int").alias("is_unique"),
    )


def select_any(members: DataFrame, good: DataFrame) -> DataFrame:
    """Transcripts with at least one good intron; ``good`` has the axis, s and e."""
    return members.join(good.select(*AXIS, "s", "e").distinct(), [*AXIS, "s", "e"], "left_semi").select("tid").distinct()


def select_all_good(members: DataFrame, good: DataFrame) -> DataFrame:
    """Transcripts whose introns are all good."""
    bad = members.join(good.select(*AXIS, "s", "e").distinct(), [*AXIS, "s", "e"], "left_anti").select("tid").distinct()
    return members.select("tid").distinct().join(bad, "tid", "left_anti")


def greedy_min_cover(members: DataFrame, good: DataFrame, expression: DataFrame) -> DataFrame:
    """Transcripts kept when good introns are used up in order (gene, falling tpm, id).

    A transcript is kept exactly when it is the first one to offer some good
    intron, so the walk is one minimum per intron.
    """
    return (
        members.join(good.select(*AXIS, "s", "e").distinct(), [*AXIS, "s", "e"], "left_semi")
        .join(expression, ["gene", "tid"])
        .groupBy(*AXIS, "s", "e")
        .agg(F.min(F.struct("gene", (-F.col("tpm")).alias("t"), "tid")).alias("f"))
        .select("f.tid")
        .distinct()
    )
