"""Breakpoints of reads that align to two genomes.

Spark does the work between reads: alignments meet annotation sites and genes
by range joins, the alignments of a read to both genomes by an equality join.  Alignments become stretches; laid out one behind
another they give base scores and genome positions as array columns.  The scan
of pairs does so for many reads at a time (:mod:`.borders`); reads that lack a
value go by the columns here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chains as C
from . import borders
from .islands import merge_intervals

# Column names of the formats.
FIELDS = ("qseqid", "qlen", "sseqid", "qstart", "qend", "sstart", "send", "btop")
BREAKPOINT_FIELDS = (
    "read_name", "genome1_read_breakpoint", "genome2_read_breakpoint", "genome1_seqid", "genome2_seqid",
    "genome1_breakpoint", "genome2_breakpoint", "score", "junction1", "junction2", "gene1", "gene2", "binread",
)
GROUP_KEYS = (
    "genome1_seqid", "genome2_seqid", "genome1_breakpoint", "genome2_breakpoint", "junction1", "junction2", "gene1", "gene2",
)


def splice_sites(tx: DataFrame) -> DataFrame:
    """(seqid, pos, kind, gene): donor and acceptor positions; of several genes the last transcript id wins."""
    s = tx.where(F.size("chain") > 1).select("seqid", "gene", "tid", F.explode(C.sites(F.col("chain"), F.col("strand"))).alias("x"))
    two = F.array(
        F.struct(F.lit("d").alias("kind"), F.col("x.donor").alias("pos")), F.struct(F.lit("a").alias("kind"), F.col("x.acceptor").alias("pos"))
    )
    rows = s.select("seqid", "gene", "tid", F.explode(two).alias("y")).select("seqid", "gene", "tid", "y.kind", "y.pos")
    return rows.groupBy("seqid", "pos", "kind").agg(F.max_by("gene", "tid").alias("gene"))


def gene_spans(tx: DataFrame) -> DataFrame:
    """(seqid, gs, ge, gene, exon): transcript spans and exons of every gene."""
    whole = tx.select("seqid", F.col("start").alias("gs"), F.col("end").alias("ge"), "gene", F.lit(0).alias("exon"))
    ex = tx.select("seqid", "gene", F.explode("chain").alias("x")).select("seqid", F.col("x.s").alias("gs"), F.col("x.e").alias("ge"), "gene", F.lit(1).alias("exon"))
    return whole.unionByName(ex).distinct()


#: Sites and genes are kept by bins of 2**BIN_BITS positions.
BIN_BITS = 8


def _bins(sites: DataFrame, spans: DataFrame) -> DataFrame:
    """(seqid, bin, donors, acceptors, spans): what stands in each bin; the spans of a gene are merged, as only their union matters."""
    # a gene without a name is one, too; a span without an end counts by its start
    named = spans.select("seqid", F.struct(F.col("gene").cast("string").alias("gene")).alias("g"), "exon", F.col("gs").cast("bigint").alias("gs"), F.greatest("gs", "ge").cast("bigint").alias("ge"))
    merged = merge_intervals(named, ["seqid", "g", "exon"], "gs", "ge", gap=1)
    none = lambda t: F.lit(None).cast(t)
    site, span = "struct<pos:bigint,gene:string>", "struct<gs:bigint,ge:bigint,gene:string,exon:int>"
    at = F.struct(F.col("pos").cast("bigint").alias("pos"), "gene").cast(site)
    points = sites.select("seqid", F.shiftright(F.col("pos").cast("bigint"), BIN_BITS).alias("bin"), F.when(F.col("kind") == "d", at).alias("d"), F.when(F.col("kind") == "a", at).alias("a"), none(span).alias("x"))
    first, last = F.shiftright(F.col("gs"), BIN_BITS), F.shiftright(F.col("ge"), BIN_BITS)
    spread = merged.select("seqid", F.explode(F.sequence(first, last)).alias("bin"), none(site).alias("d"), none(site).alias("a"), F.struct("gs", "ge", "g.gene", "exon").cast(span).alias("x"))
    return points.unionByName(spread).groupBy("seqid", "bin").agg(*[F.collect_list(c).alias(name) for c, name in (("d", "donors"), ("a", "acceptors"), ("x", "spans"))])


def _met(aln: DataFrame, sites: DataFrame, spans: DataFrame) -> DataFrame:
    """(FIELDS, donors, acceptors, hits): distinct alignments with the sites near them and what genes they touch, a row for each bin in their reach."""
    base = aln.select(*FIELDS).distinct()
    lo, hi = F.least("sstart", "send").cast("bigint"), F.greatest("sstart", "send").cast("bigint")
    # the read may reach past its aligned part by its whole length on either side
    far_lo, far_hi = lo - F.col("qlen"), hi + F.col("qlen")
    reach = F.sequence(F.shiftright(F.least(lo, far_lo), BIN_BITS), F.shiftright(F.greatest(hi, far_hi), BIN_BITS))
    met = base.select(*FIELDS, F.col("sseqid").alias("seqid"), F.explode_outer(reach).alias("bin")).join(_bins(sites, spans), ["seqid", "bin"], "left")
    near = lambda c: F.filter(c, lambda x: (x["pos"] >= far_lo) & (x["pos"] <= far_hi)).alias(c)
    # what touches the aligned part stands in one of its own bins, too
    own = (lo < hi) & (F.col("bin") >= F.shiftright(lo, BIN_BITS)) & (F.col("bin") <= F.shiftright(hi, BIN_BITS))
    touched = F.when(own, F.filter("spans", lambda x: (x["gs"] < hi) & (x["ge"] >= lo)))
    hits = F.transform(touched, lambda x: F.struct(x["gene"].alias("gene"), x["exon"].alias("exon"))).alias("hits")
    # one exchange on the read serves all that follows
    return met.select(*FIELDS, near("donors"), near("acceptors"), hits).repartition("qseqid")


def _gene_text(hits):
    """``gene:exon;gene:intron`` of (gene, exon) entries, ``-`` for none."""
    of = lambda g: F.array_contains(hits, F.struct(g.alias("gene"), F.lit(1).alias("exon")))
    words = F.transform(F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["gene"]))), lambda g: F.concat(g, F.lit(":"), F.when(of(g), "exon").otherwise("intron")))
    return F.when(F.size(hits) > 0, F.array_join(words, ";")).otherwise("-")


def profile(aln: DataFrame, sites: DataFrame, spans: DataFrame) -> DataFrame:
    """Distinct alignments with the sites near them and the text of the genes they touch.

    An alignment meets the bins in its reach, a row each, not each site and gene by itself.
    """
    found = _met(aln, sites, spans).groupBy(*FIELDS).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("donors", "acceptors", "hits")])
    return found.select(*FIELDS, F.concat_ws("\t", *FIELDS).alias("line"), F.array_sort("donors").alias("donors"), F.array_sort("acceptors").alias("acceptors"), _gene_text(F.col("hits")).alias("genes"))


def _by_read(aln: DataFrame, tx: DataFrame, name: str) -> DataFrame:
    """(qseqid, ``name``): the rows of :func:`_met` of each read, in the order of their lines."""
    rows = _met(aln, splice_sites(tx), gene_spans(tx)).where("qseqid IS NOT NULL")
    row = F.struct(F.concat_ws("\t", *FIELDS).alias("line"), *FIELDS, "donors", "acceptors", "hits")
    return rows.groupBy("qseqid").agg(F.array_sort(F.collect_list(row)).alias(name))


def _runs(btop, first):
    """Stretches of an alignment: read index q, length n, moves on read (r) and genome (g), score s of a base."""
    def stretch(o):
        number = o.rlike("^[0-9]")
        gap_read, gap_genome = o.startswith("-"), o.endswith("-")
        return F.struct(
            F.when(number, o.try_cast("int")).otherwise(1).alias("n"), (~gap_read).cast("int").alias("r"), (~gap_genome).cast("int").alias("g"),
            F.when(number, 1).when(gap_read | gap_genome, -1).otherwise(0).alias("s"),
        )

    def append(state, x):
        row = F.struct(state["q"].alias("q"), x["n"].alias("n"), x["r"].alias("r"), x["g"].alias("g"), x["s"].alias("s"))
        return F.struct((state["q"] + x["n"] * x["r"]).alias("q"), F.concat(state["rows"], F.array(row)).alias("rows"))

    none = F.array().cast("array<struct<q:int,n:int,r:int,g:int,s:int>>")
    return F.aggregate(F.transform(btop, stretch), F.struct(first.cast("int").alias("q"), none.alias("rows")), append, lambda s: s["rows"])


def _total(values, of):
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + of(x))


def _bases(runs, qlen):
    """Score of every read base: a gap counts on the base it takes or comes before.

    Stretches that take bases are laid out one behind another; only gaps of the read are looked for by position.
    """
    zero, n = F.lit(0).cast("bigint"), qlen.cast("int")
    before = F.coalesce(F.get(runs, F.lit(0))["q"], F.lit(0))
    laid = F.flatten(F.transform(F.filter(runs, lambda u: u["r"] == 1), lambda u: F.array_repeat(u["s"].cast("bigint"), u["n"])))
    scores = F.slice(F.concat(F.array_repeat(zero, before), laid, F.array_repeat(zero, n)), F.lit(1), n)
    here = lambda gaps, x: _total(gaps, lambda u: F.when(u["q"] == x, u["s"]).otherwise(0))
    return C.let(F.filter(runs, lambda u: u["r"] == 0), lambda gaps: F.when(F.size(gaps) == 0, scores).otherwise(F.transform(scores, lambda v, x: v + here(gaps, x))))


def _places(runs, qlen, first, start, step):
    """Genome position at every border of the read, extended in a straight line beyond the aligned part.

    Gaps left of a border shift it; a border behind a base that the genome lacks has no position.  Only gaps are summed.
    """
    def of(gaps):
        shift = lambda x: _total(gaps, lambda u: F.when(u["q"] < x, u["g"] - u["r"]).otherwise(0))
        lacks = lambda x: F.exists(gaps, lambda u: (u["g"] == 0) & (u["q"] == x - 1))
        return F.transform(F.sequence(F.lit(0), qlen.cast("int") - 1), lambda x: F.when(~lacks(x), start + step * (x - first + shift(x))))

    return C.let(F.filter(runs, lambda u: u["g"] != u["r"]), of)


def _marks(places, sites):
    """(i, label): borders of the read at annotated sites, in read order."""
    none = F.array().cast("array<struct<pos:bigint,gene:string>>")
    found = F.transform(F.coalesce(sites, none), lambda s: F.struct((F.array_position(places, s["pos"]) - 1).cast("int").alias("i"), s["gene"].alias("label")))
    return F.array_sort(F.filter(found, lambda m: m["i"] >= 0))


def _ways(col):
    """Bases, places, donors and acceptors of both reading directions of an alignment, whose fields ``col`` gives."""
    ops = F.regexp_extract_all(col("btop"), F.lit("[0-9]+|[A-Za-z-]{2}"), F.lit(0))
    step = F.when(col("sstart") < col("send"), 1).otherwise(-1)
    one = lambda runs, at: F.struct(_bases(runs, col("qlen")).alias("bases"), at.alias("places"), _marks(at, col("donors")).alias("donors"), _marks(at, col("acceptors")).alias("acceptors"))
    way = lambda ordered, first, start, turn: C.let(_runs(ordered, first), lambda runs: C.let(_places(runs, col("qlen"), first, col(start), turn), lambda at: one(runs, at)))
    return F.array(way(ops, col("qstart") - 1, "sstart", step), way(F.reverse(ops), col("qlen") - col("qend"), "send", -step))


def with_ways(aln: DataFrame, tag: str = "") -> DataFrame:
    """``aln`` with ``ways``: bases, places, donors and acceptors of both reading directions; ``tag`` ends the names of all columns."""
    return aln.withColumn("ways" + tag, _ways(lambda c: F.col(c + tag))).drop("donors" + tag, "acceptors" + tag)


def border(one, two):
    """The cut that maximises ``one`` before and ``two`` behind it; the rounded-down mean of tied cuts."""
    start = F.struct(*[F.lit(v).cast("bigint").alias(k) for k, v in (("i", 0), ("sum", 0), ("top", None), ("at", 0), ("ties", 0))])

    def step(a, gain):
        more, tie = a["top"].isNull() | (a["sum"] > a["top"]), a["sum"] == a["top"]
        return F.struct(
            (a["i"] + 1).alias("i"), (a["sum"] + gain).alias("sum"), F.when(more, a["sum"]).otherwise(a["top"]).alias("top"),
            F.when(more, a["i"]).when(tie, a["at"] + a["i"]).otherwise(a["at"]).alias("at"),
            F.when(more, F.lit(1).cast("bigint")).when(tie, a["ties"] + 1).otherwise(a["ties"]).alias("ties"),
        )

    return F.aggregate(F.zip_with(one, two, lambda a, b: a - b), start, step, lambda a: F.floor(a["at"] / a["ties"]).cast("int"))


def cuts(left, right, donors, acceptors, cut, full: int, half: int):
    """Candidate cuts: the border, donors, acceptors, and donors directly before an acceptor.

    A lone donor weighs ``half``; donor and acceptor side by side weigh ``full`` each.
    """
    def candidate(at, kept, weights, label1=None, label2=None):
        mid = F.array(*[F.lit(w).cast("bigint") for w in weights]).cast("array<bigint>")
        rest = F.slice(right, kept + len(weights) + 1, F.size(right))
        text = lambda x: F.lit(None).cast("string") if x is None else x
        vector = F.concat(F.slice(left, F.lit(1), kept), mid, rest)
        return F.struct(at.alias("cut"), vector.alias("vector"), text(label1).alias("junction1"), text(label2).alias("junction2"))

    lone_d = F.transform(donors, lambda d: candidate(d["i"], d["i"], [half], d["label"]))
    lone_a = F.transform(acceptors, lambda a: candidate(a["i"], a["i"] + 1, [], None, a["label"]))
    beside = lambda d: F.filter(acceptors, lambda a: a["i"] == d["i"] + 1)
    both = F.flatten(F.transform(donors, lambda d: F.transform(beside(d), lambda a: candidate(d["i"], d["i"], [full, full], d["label"], a["label"]))))
    return F.concat(F.array(candidate(cut, cut, [])), both, lone_d, lone_a)


def _ranked(one, two, cut, full: int, half: int):
    """All trials of one reading direction over both orders, as (neg, nth, t); the smallest is the best."""
    straight = cuts(one["bases"], two["bases"], one["donors"], two["acceptors"], cut, full, half)
    crossed = cuts(two["bases"], one["bases"], two["donors"], one["acceptors"], cut, full, half)
    return F.transform(F.concat(straight, crossed), lambda t, nth: F.struct((-(_total(t["vector"], lambda x: x) / F.size(t["vector"]))).alias("neg"), nth.alias("nth"), t.alias("t")))


def _best_by_row(full: int, half: int):
    """What :func:`.borders.best_cuts` gives, for any read."""
    def best(way, one, two, lines):
        row = lambda b: F.struct(
            b["neg"].alias("neg"), *lines, F.lit(way).alias("way"), b["nth"].alias("nth"), (-b["neg"]).alias("score"), b["t"]["cut"].alias("cut"),
            F.get(one["places"], b["t"]["cut"]).alias("place1"), F.get(two["places"], b["t"]["cut"] - 1).alias("place2"),
            b["t"]["junction1"].alias("junction1"), b["t"]["junction2"].alias("junction2"), F.array_join(b["t"]["vector"].cast("array<string>"), "").alias("binread"),
        )
        return C.let(C.let(border(one["bases"], two["bases"]), lambda cut: F.array_min(_ranked(one, two, cut, full, half))), row)

    def pair(u, v):
        lines = (u["line"].alias("line1"), v["line"].alias("line2"), u["at"].alias("one"), v["at"].alias("two"))
        return C.let(F.struct(u["ways"].alias("a"), v["ways"].alias("b")), lambda w: F.array_min(F.array(*[best(k, F.get(w["a"], F.lit(k)), F.get(w["b"], F.lit(k)), lines) for k in (0, 1)])))

    def alignments(rows):
        fields = lambda x: F.struct(*[x[c] for c in FIELDS])
        first = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: (i == 0) | ~fields(F.get(rows, i)).eqNullSafe(fields(F.get(rows, i - 1))))

        def one(i):
            a = F.get(rows, i)
            near = lambda c: F.array_sort(F.flatten(F.array_compact(F.transform(F.filter(rows, lambda x: fields(x).eqNullSafe(fields(a))), lambda x: x[c]))))
            ways = C.let(F.struct(near("donors").alias("donors"), near("acceptors").alias("acceptors")), lambda s: _ways(lambda c: s[c] if c in ("donors", "acceptors") else a[c]))
            return F.struct(a["line"].alias("line"), i.alias("at"), ways.alias("ways"))

        return F.transform(first, one)

    every = C.let(alignments(F.col("rows_2")), lambda two: F.array_min(F.flatten(F.transform(alignments(F.col("rows_1")), lambda u: F.transform(two, lambda v: pair(u, v))))))
    return C.let(every, lambda r: F.struct(*[r[c].alias(c) for c in re.findall(r"(\w+):", borders.RESULT)]).cast(borders.RESULT))


def best_cuts(reads: DataFrame, full: int = 5, half: int = 3) -> DataFrame:
    """``reads`` (qseqid, rows_1, rows_2) with ``best``: the best of what :func:`score_pairs` gives for the pairs of a read."""
    cols = ("qlen", "qstart", "qend", "sstart", "send", "sseqid", "btop", "donors", "acceptors")
    asked = lambda name: F.arrays_zip(*[F.col(name)[c].alias(c) for c in cols])
    fast = F.arrow_udf(borders.best_cuts(full, half), borders.RESULT)
    return reads.withColumn("best", fast(asked("rows_1"), asked("rows_2"))).withColumn("best", F.coalesce("best", _best_by_row(full, half)))


def score_pairs(pairs: DataFrame, full: int = 5, half: int = 3) -> DataFrame:
    """The best cut of each reading direction of a pair of alignments (columns ``*_1`` and ``*_2``), over both orders."""
    keep = ["_read", F.col("qseqid_1").alias("read_name"), "line_1", "line_2", F.col("sseqid_1").alias("genome1_seqid"), F.col("sseqid_2").alias("genome2_seqid"),
            F.col("genes_1").alias("gene1"), F.col("genes_2").alias("gene2")]
    each = pairs.select(*keep, F.posexplode(F.arrays_zip("ways_1", "ways_2")).alias("way", "w"))
    each = each.select("*", F.col("w.ways_1").alias("one"), F.col("w.ways_2").alias("two")).drop("w")
    each = each.withColumn("cut", border(F.col("one.bases"), F.col("two.bases")))
    # trials are compared within the row; only the best one leaves it
    ranked = _ranked(F.col("one"), F.col("two"), F.col("cut"), full, half)
    best = each.select("*", F.explode(F.array(F.array_min(ranked))).alias("best")).where("best IS NOT NULL").select("*", F.col("best.t").alias("t"))
    return best.select(
        *[c for c in each.columns if c not in ("one", "two", "cut", "way")], F.struct("way", F.col("best.nth").alias("nth")).alias("trial"),
        (-F.col("best.neg")).alias("score"),
        F.col("t.cut").cast("bigint").alias("genome1_read_breakpoint"), (F.col("t.cut") - 1).cast("bigint").alias("genome2_read_breakpoint"),
        F.get("one.places", F.col("t.cut")).alias("genome1_breakpoint"), F.get("two.places", F.col("t.cut") - 1).alias("genome2_breakpoint"),
        F.coalesce("t.junction1", F.lit("-")).alias("junction1"), F.coalesce("t.junction2", F.lit("-")).alias("junction2"),
        F.array_join(F.col("t.vector").cast("array<string>"), "").alias("binread"),
    )


def find_breakpoints(
    aln1: DataFrame, aln2: DataFrame, tx1: DataFrame, tx2: DataFrame, *, full: int = 5, half: int = 3
) -> DataFrame:
    """The best breakpoint of every read aligned to both genomes (13 columns).

    Highest score first; of equal scores the first pair in line order.  Copies
    of an alignment are removed before pairs are formed.  Base scores and places are laid out once the alignments
    have met, so no exchange carries them.
    """
    reads = _by_read(aln1, tx1, "rows_1").join(_by_read(aln2, tx2, "rows_2"), "qseqid")
    scored = best_cuts(reads, full, half)
    chosen = lambda k, at: F.get(F.col(f"rows_{k}"), F.col(at))
    scored = scored.withColumn("one", chosen(1, "best.one")).withColumn("two", chosen(2, "best.two"))

    def genes(k, name):
        same = lambda x: F.struct(*[x[c] for c in FIELDS]).eqNullSafe(F.struct(*[F.col(name)[c] for c in FIELDS]))
        return C.let(F.flatten(F.array_compact(F.transform(F.filter(f"rows_{k}", same), lambda x: x["hits"]))), _gene_text)

    return scored.select(
        F.col("qseqid").alias("read_name"), F.col("best.cut").cast("bigint").alias("genome1_read_breakpoint"), (F.col("best.cut") - 1).cast("bigint").alias("genome2_read_breakpoint"),
        F.col("one.sseqid").alias("genome1_seqid"), F.col("two.sseqid").alias("genome2_seqid"), F.col("best.place1").alias("genome1_breakpoint"), F.col("best.place2").alias("genome2_breakpoint"),
        F.col("best.score").alias("score"), F.coalesce("best.junction1", F.lit("-")).alias("junction1"), F.coalesce("best.junction2", F.lit("-")).alias("junction2"),
        genes(1, "one").alias("gene1"), genes(2, "two").alias("gene2"), F.col("best.binread").alias("binread"),
    )


def group_breakpoints(bps: DataFrame) -> DataFrame:
    """Number of reads per breakpoint, junction and gene labels."""
    return bps.groupBy(*GROUP_KEYS).agg(F.count(F.lit(1)).alias("count"))


def breakpoint_weights(bps: DataFrame) -> DataFrame:
    """(seqid, pos, weight): reads at each breakpoint side, plus one per junction they carry."""
    w = F.lit(1) + (F.col("junction1") != "-").cast("bigint") + (F.col("junction2") != "-").cast("bigint")
    sides = F.array(*[F.struct(F.col(f"genome{k}_seqid").alias("seqid"), F.col(f"genome{k}_breakpoint").alias("pos")) for k in (1, 2)])
    return bps.select(w.alias("w"), F.explode(sides).alias("x")).groupBy("x.seqid", "x.pos").agg(F.sum("w").cast("bigint").alias("weight"))
