"""Record filters, pseudogenes, coordinates of a region, and united annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chains as C


def on_alt_contig(seqid: Column) -> Column:
    return F.contains(seqid, F.lit("_alt"))


def is_pseudogene(kind: Column, attrs: Column) -> Column:
    """A feature type that begins with ``pseudo``, an attribute like ``is_pseudo`` that is true, or a ``...type`` of a pseudogene.

    ``attrs`` is the attribute map; flags are true if their value begins with t, y or 1.
    """
    flag = lambda k, v: k.rlike("(?i)^(is_?)?pseudo") & v.rlike("(?i)^[ty1]")
    typed = lambda k, v: k.rlike("(?i)type$") & v.rlike("^pseudogene|_pseudogene$")
    told = F.exists(F.map_entries(attrs), lambda x: flag(x["key"], x["value"]) | typed(x["key"], x["value"]))
    return F.coalesce(kind.startswith("pseudo"), F.lit(False)) | F.coalesce(told, F.lit(False))


def record_filter(
    tx: DataFrame, *, ids: DataFrame | None = None, exclude: DataFrame | None = None, min_bases: int = 0, max_intron: int | None = None,
    multi_exon: bool = False, coding: bool | None = None, junctions: DataFrame | None = None,
    seqid: str | None = None, strand: str | None = None, span: tuple[int, int] | None = None, within: bool = False,
) -> DataFrame:
    """Transcripts (tid, seqid, strand, start, end, chain, cds) that pass every given test.

    ids / exclude: tables of tid to keep or to drop.  ``max_intron`` bounds every gap.  ``coding``: only those with (True) or
    without (False) a coding chain.  ``span`` with ``within``: the record lies in it, else it touches it.  ``junctions``
    (seqid, strand, s, e): the record has at least one of these introns.
    """
    keep = F.lit(True)
    if min_bases:
        keep &= C.chain_length(F.col("chain")) >= min_bases
    if max_intron is not None:
        keep &= ~F.exists(C.introns(F.col("chain"), "base"), lambda x: C.length(x) > max_intron)
    if multi_exon:
        keep &= F.size("chain") > 1
    if coding is not None:
        keep &= (F.coalesce(F.size("cds"), F.lit(0)) > 0) == F.lit(coding)
    if seqid is not None:
        keep &= F.col("seqid") == seqid
    if strand is not None:
        keep &= F.col("strand") == strand
    if span is not None:
        lo, hi = span
        keep &= (F.col("start") >= lo) & (F.col("end") <= hi) if within else (F.col("start") <= hi) & (F.col("end") >= lo)
    out = tx.where(keep)
    if ids is not None:
        out = out.join(ids.select("tid").distinct(), "tid", "left_semi")
    if exclude is not None:
        out = out.join(exclude.select("tid").distinct(), "tid", "left_anti")
    if junctions is not None:
        own = out.select("tid", "seqid", "strand", F.explode(C.introns(F.col("chain"))).alias("x")).select("tid", "seqid", "strand", "x.s", "x.e")
        hit = own.join(junctions.select("seqid", "strand", "s", "e").distinct(), ["seqid", "strand", "s", "e"], "left_semi").select("tid").distinct()
        out = out.join(hit, "tid", "left_semi")
    return out


def to_region(chain: Column, lo: Column, hi: Column, flip: Column) -> Column:
    """A chain counted from 1 at the start of a region, or with ``flip`` from its end backwards; still in rising order."""
    moved = F.transform(chain, lambda x: C.interval(F.when(flip, hi - x["e"] + 1).otherwise(x["s"] - lo + 1), F.when(flip, hi - x["s"] + 1).otherwise(x["e"] - lo + 1)))
    return F.when(flip, F.reverse(moved)).otherwise(moved)


def from_region(chain: Column, lo: Column, hi: Column, flip: Column) -> Column:
    """The inverse of :func:`to_region`."""
    moved = F.transform(chain, lambda x: C.interval(F.when(flip, hi - x["e"] + 1).otherwise(x["s"] + lo - 1), F.when(flip, hi - x["s"] + 1).otherwise(x["e"] + lo - 1)))
    return F.when(flip, F.reverse(moved)).otherwise(moved)


def united(queries: DataFrame, templates: DataFrame) -> DataFrame:
    """Both sets of transcripts with ``is_template``; columns that one lacks are NULL there."""
    return queries.withColumn("is_template", F.lit(False)).unionByName(templates.withColumn("is_template", F.lit(True)), allowMissingColumns=True)
