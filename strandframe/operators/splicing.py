"""Introns, exon skipping, intron retention and alternative coding ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chains as C
from ..session import stored
from .pairs import AXIS
from .ranges import containing, holding


def explode_chain(tx: DataFrame, chain: Column, cols: list[str]) -> DataFrame:
    return tx.select(*cols, F.explode(chain).alias("_x")).select(*cols, F.col("_x.s").alias("s"), F.col("_x.e").alias("e"))


def intron_rows(tx: DataFrame, coords: str = "boundary") -> DataFrame:
    """(tid, axis, s, e) of every intron; ``coords`` is the gap convention."""
    return explode_chain(tx, C.introns(F.col("chain"), coords), ["tid", *AXIS])


def unique_introns(tx: DataFrame, coords: str = "boundary") -> DataFrame:
    """Distinct introns with the number of transcripts that carry each."""
    rows = intron_rows(tx, coords)
    return rows.groupBy(*AXIS, "s", "e").agg(F.count(F.lit(1)).alias("n_tids"), F.min("tid").alias("first_tid"))


# The labels of the report, in its order: two of codons, then three for each block.
CODON_LABELS = ("Alternative Starts", "Alternative Ends")
BLOCK_LABELS = (
    ("Total number of Exons in Template", "Template Exons Skipped", "Query Transcripts Skipping tmpl Exons"),
    ("Total number of Coding Exons in Template", "Template Coding Exons Skipped", "Query Transcripts Skipping tmpl Coding Exons"),
    ("Total number of introns in Template", "Template Introns Retained", "Query Transcripts Retaining tmpl Introns"),
    ("Total number of Coding Introns in Template", "Template Coding Introns Retained", "Query Transcripts Retaining tmpl Coding Introns"),
)


def _codons(tx: DataFrame, template: bool) -> DataFrame:
    """(axis, end, codon, template): first (end 0) and last (1) three coding coordinates of each transcript."""
    chain, minus = F.col("cds"), F.col("strand") == "-"
    low, high = C.first_positions(chain, 3), C.first_positions(chain, 3, reverse=True)
    ok = low.isNotNull() & high.isNotNull()
    both = F.array(F.when(minus, high).otherwise(low), F.when(minus, low).otherwise(high))
    rows = tx.where(F.size("cds") > 0).where(ok).select(*AXIS, F.posexplode(both).alias("end", "pos"))
    return rows.select(*AXIS, "end", F.array_join("pos", ",").alias("codon"), F.lit(template).alias("template"))


def _tagged(tx: DataFrame, cols: list[str], chains: list[Column]) -> DataFrame:
    """(cols, tag, s, e): the intervals of several chains of a transcript, from one look at it."""
    pairs = F.flatten(F.array(*[F.transform(c, lambda x: F.struct(F.lit(i).alias("tag"), x["s"].alias("s"), x["e"].alias("e"))) for i, c in enumerate(chains)]))  # noqa: B023
    return tx.select(*cols, F.explode(pairs).alias("x")).select(*cols, "x.*")


def splicing_changes(query: DataFrame, template: DataFrame) -> DataFrame:
    """(label, count): how a query annotation differs from a template annotation.

    Inputs have tid, the axis, chain and cds (an empty chain if not coding).
    Four blocks compare template exons, coding exons, introns and coding
    introns with query introns (the first two) and exons.  They are tags of one
    table, so every test is made once for all of them.  Containment is tested
    by running maxima, so no interval pairs are formed.
    """
    exon, cds = F.col("chain"), F.col("cds")
    gaps = C.introns(exon, "base")
    keys = ["block", *AXIS]
    t_iv = stored(_tagged(template, AXIS, [exon, cds, gaps, C.introns(cds, "base")]).withColumnRenamed("tag", "block").distinct())
    q_rows = stored(_tagged(query, ["tid", *AXIS], [gaps, exon]))
    two = F.explode(F.when(F.col("tag") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(2), F.lit(3)))).alias("block")
    q_iv = stored(q_rows.select("tag", *AXIS, "s", "e").distinct()).select("tag", *AXIS, "s", "e", two)

    inside = containing(t_iv, q_iv.drop("tag"), keys).groupBy("block").agg(F.count(F.lit(1)).alias("n0"), F.sum(F.col("is_contained").cast("bigint")).alias("n1"))
    holders = holding(q_iv, t_iv, keys).where("holds_any").select("block", "tag", *AXIS, "s", "e")
    tids = q_rows.join(holders, ["tag", *AXIS, "s", "e"]).select("block", "tid").distinct().groupBy("block").agg(F.count(F.lit(1)).alias("n2"))
    rows = inside.join(tids, "block", "full").select("block", F.posexplode(F.array("n0", "n1", "n2")).alias("k", "count"))
    codons = _codons(query, False).unionByName(_codons(template, True)).groupBy(*AXIS, "end", "codon").agg(F.max("template").alias("known"))
    ends = codons.where("NOT known").groupBy("end").agg(F.count(F.lit(1)).alias("count")).select(F.lit(-1).alias("block"), F.col("end").alias("k"), "count")

    names = [(-1, k, x) for k, x in enumerate(CODON_LABELS)] + [(b, k, x) for b, xs in enumerate(BLOCK_LABELS) for k, x in enumerate(xs)]
    labels = query.sparkSession.createDataFrame(names, "block int, k int, label string")
    return labels.join(rows.unionByName(ends), ["block", "k"], "left").select("label", F.coalesce("count", F.lit(0)).alias("count"))
