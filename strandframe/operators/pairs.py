"""Relations between overlapping transcripts.

Transcripts with the same chain are one *class* (its smallest id and a count).
Pairs are formed between classes, so a chain copied millions of times costs
one row, and the full pair list follows from the class members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chains as C
from ..session import stored
from .components import connected_components
from .islands import assign_islands
from .ranges import overlap_join, self_overlap
from .scans import running

AXIS = ["seqid", "strand"]

# Relation codes.
NO_OVERLAP, SAME_INTRONS, SHARED_INTRON, OVERLAP, BOTH_SINGLE, CONTAINED, ONE_EXON = 0, 1, 2, 3, 4, 5, 6


def chain_classes(tx: DataFrame, by: list[str] = AXIS) -> DataFrame:
    """One row per distinct chain: (by..., chain, start, end, tid = smallest id, n_tx)."""
    return (
        tx.groupBy(*by, "chain")
        .agg(F.min("tid").alias("tid"), F.count(F.lit(1)).alias("n_tx"))
        .withColumn("start", C.chain_start(F.col("chain")))
        .withColumn("end", C.chain_end(F.col("chain")))
    )


def class_members(tx: DataFrame, by: list[str] = AXIS) -> DataFrame:
    """(tid, class_tid): which class each transcript belongs to."""
    reps = tx.groupBy(*by, "chain").agg(F.min("tid").alias("class_tid"))
    return tx.join(reps, [*by, "chain"]).select("tid", "class_tid")


def relation(a: Column, b: Column, bases: Column) -> Column:
    """Relation code of two chains on one axis that share ``bases`` exon bases."""
    single_a, single_b = F.size(a) == 1, F.size(b) == 1
    a_s, a_e, b_s, b_e = C.chain_start(a), C.chain_end(a), C.chain_start(b), C.chain_end(b)
    nested = ((a_s <= b_s) & (a_e >= b_e)) | ((b_s <= a_s) & (b_e >= a_e))
    multi = ~single_a & ~single_b
    one = (C.exons_touching(a, b_s, b_e) == 1) | (C.exons_touching(b, a_s, a_e) == 1)
    return (
        F.when(bases == 0, F.when(nested, CONTAINED).otherwise(NO_OVERLAP))
        .when(single_a & single_b, BOTH_SINGLE)
        .when(multi & (C.introns(a) == C.introns(b)), SAME_INTRONS)
        .when(multi & (C.shared_introns(a, b) > 0), SHARED_INTRON)
        .when(one, ONE_EXON)
        .otherwise(OVERLAP)
    )


def add_relation(pairs: DataFrame) -> DataFrame:
    """Add bases and status to pairs that carry ``l_chain`` and ``r_chain``."""
    a, b = F.col("l_chain"), F.col("r_chain")
    return pairs.withColumn("bases", C.shared_bases(a, b)).withColumn("status", relation(a, b, F.col("bases")))


def classify_pairs(tx: DataFrame) -> DataFrame:
    """Relation of every pair of overlapping chain classes.

    (tid1, tid2, n1, n2, status, bases, span_bases, shared_introns, introns1,
    introns2); pairs of non-overlapping transcripts have status 0 by
    definition and are not listed.  A class with copies appears as
    tid1 = tid2.
    """
    cls = chain_classes(tx).select(*AXIS, "tid", "n_tx", "start", "end", "chain")
    between = add_relation(self_overlap(cls, AXIS, "tid"))
    own = (
        cls.where("n_tx > 1")
        .select(*AXIS, *[F.col(c).alias(f"{p}{c}") for p in ("l_", "r_") for c in ("tid", "n_tx", "start", "end", "chain")])
        .withColumn("bases", C.chain_length(F.col("l_chain")))
        .withColumn("status", F.when(F.size("l_chain") == 1, BOTH_SINGLE).otherwise(SAME_INTRONS))
    )
    a, b = F.col("l_chain"), F.col("r_chain")
    return between.unionByName(own).select(
        *AXIS,
        F.col("l_tid").alias("tid1"),
        F.col("r_tid").alias("tid2"),
        F.col("l_n_tx").alias("n1"),
        F.col("r_n_tx").alias("n2"),
        F.col("status").cast("int").alias("status"),
        "bases",
        (F.least("l_end", "r_end") - F.greatest("l_start", "r_start") + 1).alias("span_bases"),
        C.shared_introns(a, b).alias("shared_introns"),
        (F.size(a) - 1).alias("introns1"),
        (F.size(b) - 1).alias("introns2"),
    )


def singletons(tx: DataFrame, axis: list[str] = ["seqid"]) -> DataFrame:
    """Transcripts alone in their bundle (strandless by default)."""
    placed = assign_islands(tx.select("tid", *AXIS, "gene", "start", "end"), axis, "start", "end", out="bundle")
    alone = placed.groupBy(*axis, "bundle").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("tid")).where("n = 1")
    return placed.join(alone.select("tid"), "tid", "left_semi")


def query_template_pairs(tx: DataFrame) -> DataFrame:
    """Relations between overlapping query classes (l_) and template classes (r_)."""
    cls = chain_classes(tx, [*AXIS, "is_template"])
    cols = [*AXIS, "tid", "start", "end", "chain"]
    return add_relation(
        overlap_join(cls.where(~F.col("is_template")).select(*cols), cls.where("is_template").select(*cols), AXIS)
    )


def _containment_runs(tx: DataFrame) -> DataFrame:
    """(axis, start, run): transcripts linked by containment of spans share a run.

    In order of start, a run ends exactly where every end so far is smaller
    than every end still to come.
    """
    ends = tx.groupBy(*AXIS, "start").agg(F.max("end").alias("hi"), F.min("end").alias("lo"))
    up = running(ends, AXIS, "start", {"before": ("hi", "max")})
    both = running(up, AXIS, "start", {"after": ("lo", "min")}, reverse=True, inclusive=True)
    opens = F.col("before").isNull() | (F.col("before") < F.col("after"))
    cut = both.withColumn("open", F.when(opens, F.col("start")))
    return running(cut, AXIS, "start", {"run": ("open", "max")}, inclusive=True).select(*AXIS, "start", "run")


def span_components(tx: DataFrame) -> DataFrame:
    """(tid, component): transcripts joined by shared exon bases or by containment.

    No transcript pairs are formed.  All exons that touch form an island, all
    spans linked by containment form a run; each transcript links its islands
    and its run, and only those distinct links enter the component search.
    """
    base = tx.select("tid", *AXIS, "start", "chain")
    ex = base.select("tid", *AXIS, F.explode("chain").alias("x")).select("tid", *AXIS, F.col("x.s").alias("s"), F.col("x.e").alias("e"))
    isl = assign_islands(ex, AXIS, "s", "e", out="island")
    node = lambda kind, pos: F.concat_ws("|", *AXIS, F.lit(kind), pos.cast("string"))
    ties = isl.groupBy("tid", *AXIS, "island").agg(F.lit(1)).select("tid", node("x", F.col("island")).alias("node"))
    run = base.join(_containment_runs(tx), [*AXIS, "start"]).select("tid", node("c", F.col("run")).alias("run"))
    links = stored(ties.join(run, "tid").select("tid", "run", "node"))
    comps = connected_components(links, "run", "node")
    home = links.groupBy("tid").agg(F.min("run").alias("node"))
    placed = home.join(comps, "node").select("tid", "component")
    label = placed.groupBy("component").agg(F.min("tid").alias("label"))
    return placed.join(label, "component").select("tid", F.col("label").alias("component"))


def readthrough(tx: DataFrame) -> DataFrame:
    """(tid, reader_status): queries that touch more than one template component.

    pass: exactly one component; unknown: none; fail: several.
    """
    comps = span_components(tx.where("is_template"))
    usable = (F.col("status") != NO_OVERLAP) & ~((F.size("l_chain") > 1) & (F.col("status") == ONE_EXON))
    hits = (
        query_template_pairs(tx)
        .where(usable)
        .select(F.col("l_tid").alias("class_tid"), F.col("r_tid").alias("tid"))
        .join(comps, "tid")
        .groupBy("class_tid")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    )
    members = class_members(tx.where(~F.col("is_template")))
    verdict = (
        F.when(F.col("lo").isNull(), "unknown").when(F.col("lo") == F.col("hi"), "pass").otherwise("fail")
    )
    return members.join(hits, "class_tid", "left").select("tid", verdict.alias("reader_status"))
