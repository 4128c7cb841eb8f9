"""Carry known coding chains over to query transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chains as C
from ..functions import sequences as Q
from .pairs import AXIS, chain_classes, class_members
from .ranges import overlap_join


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose value is computed once a row, also where filters and later columns use it (a generator of one row keeps it apart)."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def _bases_before(chain: Column, strand: Column, pos: Column) -> Column:
    """Chain bases before ``pos`` in transcription order."""
    zero = F.lit(0).cast("bigint")
    fwd = F.aggregate(chain, zero, lambda n, x: n + F.greatest(zero, F.least(x["e"], pos - 1) - x["s"] + 1))
    rev = F.aggregate(chain, zero, lambda n, x: n + F.greatest(zero, x["e"] - F.greatest(x["s"], pos + 1) + 1))
    return F.when(strand == "-", rev).otherwise(fwd)


def trim_to_codons(own: Column, cut: Column, template: Column, strand: Column) -> Column:
    """Own exons between the first and the last whole template codon inside ``cut``."""
    minus = strand == "-"
    first = F.when(minus, C.chain_end(cut)).otherwise(C.chain_start(cut))
    last = F.when(minus, C.chain_start(cut)).otherwise(C.chain_end(cut))
    skip = F.pmod(-_bases_before(template, strand, first), F.lit(3))
    drop = (_bases_before(template, strand, last) + 1) % 3
    begin = C.to_genome_edge(cut, strand, skip)
    end = C.to_genome_edge(cut, strand, C.chain_length(cut) - drop)
    lo, hi = F.when(minus, end).otherwise(begin), F.when(minus, begin - 1).otherwise(end - 1)
    return C.clip(own, lo, hi)


def difference(template: Column, fitted: Column, strand: Column) -> Column:
    """How a fitted chain differs from its template.

    Neighbouring unmatched pieces count as one change whose length is the
    signed sum (template-only pieces negative).  Struct of missing_start,
    missing_end, extra, missing, matched, inframe, outframe, score.
    """
    item = "array<struct<v:bigint,k:int>>"

    def fold(acc: Column, x: Column) -> Column:
        k = (x["code"] != 0).cast("int")
        v = F.when(x["code"] == -1, -C.length(x)).otherwise(C.length(x))
        last = F.element_at(F.when(F.size(acc) > 0, acc), -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct((last["v"] + v).alias("v"), k.alias("k"))))
        return F.when(last["k"] == k, joined).otherwise(F.concat(acc, F.array(F.struct(v.alias("v"), k.alias("k")))))

    def totals(runs: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        state = F.struct(*[zero.alias(n) for n in ("frame", "extra", "missing", "matched", "inframe")])

        def step(acc: Column, r: Column) -> Column:
            change = r["k"] == 1
            ok = acc["frame"] % 3 == 0
            hit = F.when(~change, r["v"]).otherwise(zero)
            return F.struct(
                (acc["frame"] + F.when(change, F.abs(r["v"]) % 3).otherwise(zero)).alias("frame"),
                (acc["extra"] + F.when(change & (r["v"] < 0), -r["v"]).otherwise(zero)).alias("extra"),
                (acc["missing"] + F.when(change & (r["v"] > 0), r["v"]).otherwise(zero)).alias("missing"),
                (acc["matched"] + hit).alias("matched"),
                (acc["inframe"] + F.when(ok, hit).otherwise(zero)).alias("inframe"),
            )

        def result(t: Column) -> Column:
            ms, me = F.element_at(runs, 1)["k"], F.element_at(runs, -1)["k"]
            out = t["matched"] - t["inframe"]
            return F.struct(
                ms.alias("missing_start"), me.alias("missing_end"), t["extra"].alias("extra"), t["missing"].alias("missing"),
                t["matched"].alias("matched"), t["inframe"].alias("inframe"), out.alias("outframe"),
                (ms * 10 + me * 10 + t["extra"] + t["missing"] + out).alias("score"),
            )

        return C.let(F.aggregate(runs, state, step), result)

    runs = F.aggregate(C.segments(template, fitted), F.array().cast(item), fold)
    return C.let(F.when(strand == "-", F.reverse(runs)).otherwise(runs), totals)


def coding_templates(tx: DataFrame, check_length: bool = True) -> DataFrame:
    """Distinct coding chains of the templates; whole codons only if ``check_length``.

    The chain keeps the id of its first transcript in the order (start, end, id).
    """
    t = tx.where("is_template").where(F.size("cds") > 0)
    if check_length:
        t = t.where(C.chain_length(F.col("cds")) % 3 == 0)
    return t.groupBy(*AXIS, "cds").agg(F.min(F.struct("start", "end", "tid")).alias("first")).select(
        *AXIS, C.chain_start(F.col("cds")).alias("start"), C.chain_end(F.col("cds")).alias("end"), "cds", "first"
    )


def fitted_chains(tx: DataFrame, check_length: bool = True) -> DataFrame:
    """Every query class with every coding chain that shares bases with it."""
    q = chain_classes(tx.where(~F.col("is_template"))).select(*AXIS, "tid", "start", "end", "chain")
    p = overlap_join(q, coding_templates(tx, check_length), AXIS)
    cut = once(p, "cut", C.clip_to_shared(F.col("l_chain"), F.col("r_cds"))).where(C.chain_length(F.col("cut")) >= 3)
    fitted = trim_to_codons(F.col("l_chain"), F.col("cut"), F.col("r_cds"), F.col("strand")) if check_length else F.col("cut")
    fit = once(cut, "fitted", fitted).where(C.chain_length(F.col("fitted")) >= 3)
    return once(fit, "d", difference(F.col("r_cds"), F.col("fitted"), F.col("strand"))).select(
        F.col("l_tid").alias("class_tid"), F.col("r_first").alias("first"), "fitted", C.chain_length(F.col("fitted")).alias("n"), "d.*"
    )


def transfer_orfs(tx: DataFrame, check_length: bool = True) -> DataFrame:
    """(tid, kind, template, chain, bases, score): the coding chain each query takes over.

    The longest perfect fit (score 0), else the longest imperfect one, else
    none; of equal lengths the first template in order.
    """
    return best_fits(fitted_chains(tx, check_length), class_members(tx.where(~F.col("is_template"))))


def best_fits(fitted: DataFrame, members: DataFrame) -> DataFrame:
    """The choice of :func:`transfer_orfs` among fitted chains of classes, for all members of the classes."""
    best = fitted.groupBy("class_tid").agg(
        F.min(F.struct((F.col("score") != 0).alias("bad"), (-F.col("n")).alias("neg"), "first", "fitted", "score")).alias("b")
    )
    kind = F.when(F.col("b").isNull(), "none").when(F.col("b.bad"), "imperfect").otherwise("perfect")
    return members.join(best, "class_tid", "left").select(
        "tid", kind.alias("kind"), F.col("b.first.tid").alias("template"), C.as_text(F.col("b.fitted")).alias("chain"),
        (-F.col("b.neg")).alias("bases"), F.col("b.score").alias("score"),
    )


def refit_with_sequence(df: DataFrame, own: str, cut: str, strand: str, genome: str, origin: str, template_start: str) -> DataFrame:
    """:func:`refit_rna` where ``genome`` is the forward sequence that covers ``own``, its first base at ``origin``."""
    rna = Q.spliced(F.col(genome), F.col(own), F.col(strand), F.col(origin))
    return refit_rna(df.withColumn("_own_rna", rna), own, cut, strand, "_own_rna", template_start).drop("_own_rna")


def refit_rna(df: DataFrame, own: str, cut: str, strand: str, rna: str, template_start: str) -> DataFrame:
    """Add ``refit``: the coding chain fitted to the sequence, within the transcript.

    ``rna`` is the sequence of ``own`` in transcription order; ``template_start``
    is the coordinate of the template's first coding base.  In transcription order: the frame of ``cut`` is read to its
    first stop, begins at its first M, is extended to the next stop of the
    transcript (the stop codon included) if there is one, and then grown
    upstream to the furthest M before any stop, but not past the template's
    own start.  NULL if nothing is left.
    """
    o, c, st, t0 = F.col(own), F.col(cut), F.col(strand), F.col(template_start)
    minus, rest = st == "-", F.lit(2**31 - 1)
    piece = lambda a, n: F.substring(rna, (a + 1).cast("int"), n.cast("int"))
    steps = {
        "_at": _bases_before(o, st, F.when(minus, C.chain_end(c)).otherwise(C.chain_start(c))),
        "_t": F.when(F.exists(o, lambda x: (x["s"] <= t0) & (x["e"] >= t0)), _bases_before(o, st, t0)),
        "_frame": Q.translate(piece(F.col("_at"), C.chain_length(c))),
        "_coding": F.regexp_extract("_frame", r"^([^.]*)", 1),
        "_m": F.greatest(F.instr("_coding", "M") - 1, F.lit(0)),
        "_begin": F.col("_at") + F.col("_m") * 3,
        "_kept": F.length("_coding") - F.col("_m"),
        "_tail": Q.translate(piece(F.col("_begin"), rest)),
        "_stop": F.instr("_tail", "."),
        "_codons": F.when(F.col("_stop") > 0, F.col("_stop")).otherwise(F.col("_kept")),
        "_head": Q.translate(piece(F.col("_begin") % 3, F.col("_begin") - F.col("_begin") % 3)),
        "_ahead": F.regexp_extract("_head", r"([^.]*)$", 1),
        # codons after the template's start may be used; the start itself ends the search
        "_limit": F.when((F.col("_t") < F.col("_begin")) & ((F.col("_begin") - F.col("_t")) % 3 == 0), F.expr("(_begin - _t) div 3 - 1")),
        "_usable": F.when(F.col("_limit") < F.length("_ahead"), F.right("_ahead", F.col("_limit").cast("int"))).otherwise(F.col("_ahead")),
        "_up": F.instr("_usable", "M"),
        "_grown": F.when(F.col("_up") > 0, F.length("_usable") - F.col("_up") + 1).otherwise(F.lit(0)),
        "_from": F.col("_begin") - F.col("_grown") * 3,
        "_a": C.to_genome(o, st, F.col("_from")),
        "_b": C.to_genome(o, st, F.col("_from") + (F.col("_codons") + F.col("_grown")) * 3 - 1),
    }
    out = df
    for name, value in steps.items():
        out = once(out, name, value)
    return once(out, "refit", F.when(F.col("_kept") > 0, C.clip(o, F.least("_a", "_b"), F.greatest("_a", "_b")))).drop(*steps)
