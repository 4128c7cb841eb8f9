"""Gene-level summaries, id assignment and release building."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chains as C
from ..session import stored
from .islands import assign_islands
from .labels import best_template
from .pairs import AXIS, BOTH_SINGLE, SAME_INTRONS, class_members, span_components
from .scans import numbered, running


def gene_rows(tx: DataFrame) -> DataFrame:
    """One row per gene: span, strand ('.' if mixed) and number of transcripts.

    Optional columns gene_name and gene_type are joined as sorted lists.  A
    gene on several sequences raises an error.
    """
    aggs = [
        F.min("seqid").alias("seqid"), F.max("seqid").alias("_seq_hi"),
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.min("strand").alias("_st_lo"), F.max("strand").alias("_st_hi"),
        F.count(F.lit(1)).alias("n_tx"),
    ]
    named = [c for c in ("gene_name", "gene_type") if c in tx.columns]
    aggs += [F.array_join(F.array_sort(F.collect_set(c)), ", ").alias(c) for c in named]
    g = tx.groupBy("gene").agg(*aggs)
    bad = F.raise_error(F.concat(F.lit("gene on several sequences: "), F.col("gene").cast("string")))
    return g.select(
        "gene",
        F.when(F.col("seqid") == F.col("_seq_hi"), F.col("seqid")).otherwise(bad).alias("seqid"),
        "start", "end",
        F.when(F.col("_st_lo") == F.col("_st_hi"), F.col("_st_lo")).otherwise(".").alias("strand"),
        "n_tx", *named,
    )


def gene_lines(tx: DataFrame, descriptions: DataFrame, source: str = "strandframe") -> DataFrame:
    """(gene, seqid, start, value): annotation lines of genes with their types, names and the names' descriptions, all sorted.

    tx as for :func:`gene_rows` with gene_name and gene_type; descriptions: name, description.  A single described name gives its
    description alone, several give ``name : description`` each.
    """
    rows = gene_rows(tx)
    known = tx.select("gene", F.col("gene_name").alias("name")).distinct().join(descriptions.where("description IS NOT NULL"), "name")
    listed = known.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("name", "description"))).alias("d"))
    told = F.array_join(F.transform("d", lambda x: F.concat(x["name"], F.lit(" : "), x["description"])), ", ")
    text = F.when(F.size("d") == 1, F.get("d", F.lit(0))["description"]).otherwise(told)
    field = lambda name, value: F.when(F.length(value) > 0, F.concat(F.lit(f'{name} "'), value, F.lit('";')))
    attrs = F.concat_ws(" ", field("gene_id", F.col("gene")), field("gene_type", F.col("gene_type")), field("gene_name", F.col("gene_name")), field("description", text))
    line = F.concat_ws("\t", "seqid", F.lit(source), F.lit("gene"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), attrs)
    return rows.join(listed, "gene", "left").select("gene", "seqid", "start", line.alias("value"))


def gene_bed(tx: DataFrame, offset: int = 1) -> DataFrame:
    """seqid, start, end, gene, score, strand; spans grown by ``offset``, start at least 1."""
    g = tx.groupBy("gene").agg(
        F.min("strand").alias("strand"), F.min("seqid").alias("seqid"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    return g.select(
        "seqid", F.greatest(F.col("start") - offset, F.lit(1)).alias("start"), (F.col("end") + offset).alias("end"),
        "gene", F.lit(".").alias("score"), "strand",
    )


def transcripts_per_gene(tx: DataFrame) -> DataFrame:
    return tx.groupBy("gene").agg(F.count("tid").alias("n_tx"))


def exons_per_transcript(ex: DataFrame) -> DataFrame:
    return ex.groupBy("tid").agg(F.count("s").alias("n_exons"))


def coding_genes(tx: DataFrame) -> DataFrame:
    return tx.where(F.size("cds") > 0).select("gene").distinct()


def coding_stats(tx: DataFrame) -> DataFrame:
    """Mean transcripts per coding gene, and mean distinct coding chains per gene."""
    per = tx.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.max((F.size("cds") > 0).cast("int")).alias("coding")).where("coding = 1")
    chains = tx.where(F.size("cds") > 0).select("gene", "cds").distinct().groupBy("gene").agg(F.count(F.lit(1)).alias("n"))
    a = per.agg(F.lit("transcripts per coding gene").alias("stat"), F.avg("n").alias("value"))
    b = chains.agg(F.lit("distinct coding chains per gene").alias("stat"), F.avg("n").alias("value"))
    return a.unionByName(b)


def adjacent_overlaps(tx: DataFrame) -> DataFrame:
    """Genes whose coding span reaches past the start of the next coding gene on the axis, and that next gene.

    ``tx`` has cds, an empty chain if not coding; genes without a coding transcript take no part.
    """
    cds = F.col("cds")
    coding = tx.where(F.size(cds) > 0).select(*AXIS, "gene", C.chain_start(cds).alias("start"), C.chain_end(cds).alias("end"))
    g = coding.groupBy(*AXIS, "gene").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    first = F.struct("start", "end", F.col("gene").alias("g"))
    heads = g.groupBy(*AXIS, "start").agg(F.min(first).alias("head"))
    nxt = running(heads, AXIS, "start", {"nxt": ("head", "min")}, reverse=True).drop("head")
    w = W.partitionBy(*AXIS, "start").orderBy("end", "gene")
    follow = F.coalesce(F.lead(first).over(w), F.col("nxt"))
    hit = g.join(nxt, [*AXIS, "start"]).withColumn("f", follow).where(F.col("end") > F.col("f.start"))
    return hit.select("gene").union(hit.select("f.g")).distinct()


def gene_filter(
    tx: DataFrame,
    *,
    drop_single_exon: bool = True,
    drop_overlapping: bool = True,
    words: tuple[str, ...] = ("selen",),
    drop_exceptions: bool = True,
    seqids: DataFrame | None = None,
    keep: DataFrame | None = None,
) -> DataFrame:
    """Transcripts of the genes that pass every filter (anti joins on gene ids).

    ``seqids`` lists the sequences to keep, ``keep`` the genes to keep.
    Text filters use the ``attributes`` column, ``drop_overlapping`` the ``cds`` column.
    """
    from ..functions.attributes import mentions

    bad = tx.select("gene").where("false")
    if drop_single_exon:
        bad = bad.union(tx.groupBy("gene").agg(F.max(F.size("chain")).alias("m")).where("m = 1").select("gene"))
    if drop_overlapping:
        bad = bad.union(adjacent_overlaps(tx))
    for word in words if "attributes" in tx.columns else ():
        bad = bad.union(tx.where(mentions(F.col("attributes"), word)).select("gene"))
    if drop_exceptions and "attributes" in tx.columns:
        bad = bad.union(tx.where(mentions(F.col("attributes"), "exception")).select("gene"))
    if seqids is not None:
        bad = bad.union(tx.join(seqids, "seqid", "left_anti").select("gene"))
    out = tx.join(bad.distinct(), "gene", "left_anti")
    return out if keep is None else out.join(keep.select("gene").distinct(), "gene", "left_semi")


def split_loci(tx: DataFrame) -> DataFrame:
    """(tid, gid, new_gid): genes whose transcripts do not all overlap are split.

    The first part keeps the number, later parts get new ones above the
    largest, in the order (gid, start).
    """
    placed = stored(assign_islands(tx.select("tid", *AXIS, "gid", "start", "end"), ["gid", *AXIS], "start", "end", out="part"))
    parts = placed.groupBy("gid").agg(F.min("part").alias("first"))
    later = placed.select("gid", "part").distinct().join(parts, "gid").where("part > first").withColumn("all", F.lit(0))
    top = tx.agg(F.max("gid").alias("top"))  # always one row, so it may be broadcast
    ranked = numbered(later, ["all"], ["gid"], ["part"], "k").join(F.broadcast(top.withColumn("all", F.lit(0))), "all")
    fresh = ranked.select("gid", "part", (F.col("top") + F.col("k")).alias("new_gid"))
    return placed.join(fresh, ["gid", "part"], "left").select("tid", "gid", F.coalesce("new_gid", "gid").alias("new_gid"))


def assign_ids(tx: DataFrame, po: int = 100) -> DataFrame:
    """Stable numeric ids for queries from a previous release.

    Templates carry ``gid`` (gene number) and ``num`` (number in the gene).
    (tid, gid, num, kind, duplicate): kind same (the template's id is reused),
    next (next free number of the template's gene) or novel (new gene for each
    cluster of unmatched queries).  Numbers follow the order (start, end, id);
    ``duplicate`` marks the second and later uses of one id.
    """
    q, t = tx.where(~F.col("is_template")), tx.where("is_template")
    best = best_template(tx)
    placed = (
        q.select("tid", *AXIS, "start", "end").join(class_members(q), "tid").join(best, "class_tid", "left")
        .join(t.select(F.col("tid").alias("template"), F.col("gid").alias("t_gid"), F.col("num").alias("t_num")), "template", "left")
    )
    covered = (F.floor(F.col("bases") * 100 / F.col("q_len")) >= po) | (F.floor(F.col("bases") * 100 / F.col("t_len")) >= po)
    same = (F.col("status") == SAME_INTRONS) | ((F.col("status") == BOTH_SINGLE) & covered)
    kind = F.when(F.col("template").isNull(), "novel").when(same, "same").otherwise("next")
    placed = stored(placed.withColumn("kind", kind))

    kept = numbered(placed.where("kind = 'same'"), ["t_gid", "t_num"], "start", ["end", "tid"], "k").select(
        "tid", F.col("t_gid").alias("gid"), F.col("t_num").alias("num"), "kind", (F.col("k") > 1).cast("int").alias("duplicate")
    )
    top = t.groupBy(F.col("gid").alias("t_gid")).agg(F.max("num").alias("top"))
    nxt = numbered(placed.where("kind = 'next'"), ["t_gid"], "start", ["end", "tid"], "k").join(top, "t_gid").select(
        "tid", F.col("t_gid").alias("gid"), (F.col("top") + F.col("k")).alias("num"), "kind", F.lit(0).alias("duplicate")
    )

    novel = stored(tx.join(placed.where("kind = 'novel'").select("tid"), "tid", "left_semi"))
    member = stored(span_components(novel).join(novel.select("tid", *AXIS, "start", "end"), "tid"))
    comps = member.groupBy(*AXIS, "component").agg(F.min("start").alias("start"))
    ranked = numbered(comps, AXIS, "start", ["component"], "r")
    # one row per axis: the only window without a partition runs over this tiny table
    sizes = comps.groupBy(*AXIS).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy(*AXIS).rowsBetween(W.unboundedPreceding, -1))
    offset = sizes.select(*AXIS, F.coalesce(before, F.lit(0)).alias("before"), F.lit(0).alias("all"))
    top_gid = t.agg(F.max("gid").alias("top")).withColumn("all", F.lit(0))
    gids = (
        ranked.join(offset, AXIS).join(F.broadcast(top_gid), "all")
        .select("component", (F.col("top") + F.col("before") + F.col("r")).alias("gid"))
    )
    fresh = numbered(member, ["component"], "start", ["end", "tid"], "k").join(gids, "component").select(
        "tid", "gid", (F.col("k") - 1).alias("num"), F.lit("novel").alias("kind"), F.lit(0).alias("duplicate")
    )
    return kept.unionByName(nxt).unionByName(fresh)


def deduplicate(tx: DataFrame) -> DataFrame:
    """One transcript per (gene, exon chain): (tid, n_copies).

    The copy with the highest positive similarity to the designated transcript
    (``ilpi``) stays, else the highest positive ``mom`` score, else the
    smallest id.  Both columns are optional.
    """
    score = lambda c: F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) if c in tx.columns else F.lit(0.0)
    base = tx.select("gene", *AXIS, "chain", "tid", score("ilpi").alias("_i"), score("mom").alias("_m"))
    best = base.groupBy("gene", *AXIS, "chain").agg(
        F.count(F.lit(1)).alias("n_copies"),
        F.max("_i").alias("_imax"), F.max("_m").alias("_mmax"),
        F.min("tid").alias("_any"),
        F.min(F.struct((-F.col("_i")).alias("v"), "tid")).alias("_by_i"),
        F.min(F.struct((-F.col("_m")).alias("v"), "tid")).alias("_by_m"),
    )
    chosen = (
        F.when(F.col("_imax") > 0, F.col("_by_i.tid")).when(F.col("_mmax") > 0, F.col("_by_m.tid")).otherwise(F.col("_any"))
    )
    return best.select(chosen.alias("tid"), "n_copies", "gene", *AXIS, "chain")


def copies_of(tx: DataFrame) -> DataFrame:
    """(tid, kept_tid): which copy stands for each transcript."""
    kept = deduplicate(tx).select(F.col("tid").alias("kept_tid"), "gene", *AXIS, "chain")
    return tx.join(kept, ["gene", *AXIS, "chain"]).select("tid", "kept_tid")


def designated_similarity(tx: DataFrame, designated: str = "is_designated") -> DataFrame:
    """Compare every coding chain with the designated transcript of its gene.

    (tid, designated_tid, metrics...).  A gene has one designated transcript;
    with several, each comparison is listed.
    """
    chosen = tx.where(F.col(designated)).select("gene", F.col("tid").alias("designated_tid"), F.col("cds").alias("cds2"))
    m = C.compare_metrics(F.col("cds"), F.col("cds2"), F.col("strand"))
    return tx.join(chosen, "gene").select("tid", "designated_tid", m.alias("m")).select("tid", "designated_tid", "m.*")
