"""Chain algebra as Column -> Column functions.

A chain is ``ARRAY<STRUCT<s: BIGINT, e: BIGINT>>``: closed intervals in rising
order.  Everything here stays inside the JVM as higher-order functions.
Two gap conventions exist: ``boundary`` (last base of one exon, first base of
the next) and ``base`` (first and last base of the gap itself).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHAIN = "array<struct<s:bigint,e:bigint>>"


def _big(x: int) -> Column:
    return F.lit(x).cast("bigint")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def interval(s: Column, e: Column) -> Column:
    return F.struct(s.cast("bigint").alias("s"), e.cast("bigint").alias("e"))


def empty_chain() -> Column:
    return F.array().cast(CHAIN)


def collect_chain(s: str = "s", e: str = "e") -> Column:
    """Aggregate: the sorted chain of a group of interval rows."""
    return F.array_sort(F.collect_list(interval(F.col(s), F.col(e))))


def length(i: Column) -> Column:
    return i["e"] - i["s"] + 1


def chain_length(chain: Column) -> Column:
    return F.aggregate(chain, _big(0), lambda a, x: a + length(x))


def chain_start(chain: Column) -> Column:
    return F.element_at(chain, 1)["s"]


def chain_end(chain: Column) -> Column:
    return F.element_at(chain, -1)["e"]


def intersect(a: Column, b: Column) -> Column:
    """Shared interval of two intervals, or NULL."""
    s, e = F.greatest(a["s"], b["s"]), F.least(a["e"], b["e"])
    return F.when(s <= e, interval(s, e))


def overlap_bases(a: Column, b: Column) -> Column:
    return F.greatest(_big(0), F.least(a["e"], b["e"]) - F.greatest(a["s"], b["s"]) + 1)


def overlaps(a_s: Column, a_e: Column, b_s: Column, b_e: Column, min_overlap: int = 1) -> Column:
    """Closed overlap; ``min_overlap=2`` gives the rule in which one shared base is not enough."""
    return F.least(a_e, b_e) - F.greatest(a_s, b_s) + 1 >= min_overlap


def split(a: Column, b: Column) -> Column:
    """(left, overlap, right) of two intervals ordered by start; missing parts are NULL."""
    inter = intersect(a, b)
    left_e = F.least(a["e"], b["s"] - 1)
    right_s = F.greatest(b["s"], F.least(a["e"], b["e"]) + 1)
    right_e = F.greatest(a["e"], b["e"])
    return F.struct(
        F.when(left_e >= a["s"], interval(a["s"], left_e)).alias("left"),
        inter.alias("overlap"),
        F.when(right_s <= right_e, interval(right_s, right_e)).alias("right"),
    )


def chain_intersection(a: Column, b: Column) -> Column:
    pieces = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: intersect(x, y))))
    return F.array_compact(pieces)


def shared_bases(a: Column, b: Column) -> Column:
    """Number of bases two chains share (each chain without inner overlaps)."""
    return F.aggregate(
        a, _big(0), lambda acc, x: acc + F.aggregate(b, _big(0), lambda n, y: n + overlap_bases(x, y))
    )


def percent_of(bases: Column, chain: Column) -> Column:
    return F.floor(bases * 100 / chain_length(chain)).cast("int")


def merge(chain: Column, gap: int = 0) -> Column:
    """Merge the intervals of one array; ``gap=1`` also joins adjacent ones."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = last["e"] + gap >= x["s"]
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        grown = F.concat(head, F.array(interval(last["s"], F.greatest(last["e"], x["e"]))))
        fresh = F.concat(acc, F.array(interval(x["s"], x["e"])))
        return F.when(F.size(acc) == 0, fresh).when(joins, grown).otherwise(fresh)

    return F.aggregate(F.array_sort(chain), empty_chain(), step)


def union(a: Column, b: Column) -> Column:
    return merge(F.concat(a, b))


def introns(chain: Column, coords: str = "boundary") -> Column:
    """Gaps between consecutive intervals."""
    d = 0 if coords == "boundary" else 1
    n = F.greatest(F.size(chain) - 1, F.lit(0))
    return F.zip_with(
        F.slice(chain, F.lit(1), n),
        F.slice(chain, F.lit(2), n),
        lambda x, y: interval(x["e"] + d, y["s"] - d),
    )


def shared_introns(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(introns(a), introns(b)))


def exons_touching(chain: Column, s: Column, e: Column) -> Column:
    """How many intervals of the chain touch the span [s, e]."""
    return F.size(F.filter(chain, lambda x: (x["s"] <= e) & (x["e"] >= s)))


def inside_exon(chain: Column, s: Column, e: Column) -> Column:
    return F.exists(chain, lambda x: (x["s"] <= s) & (x["e"] >= e))


def clip(chain: Column, s: Column, e: Column, min_bases: int = 1) -> Column:
    """Chain within [s, e]; ``min_bases=2`` drops one-base leftovers."""
    cut = F.transform(chain, lambda x: interval(F.greatest(x["s"], s), F.least(x["e"], e)))
    return F.filter(cut, lambda x: x["e"] - x["s"] + 1 >= min_bases)


def clip_to_shared(own: Column, other: Column) -> Column:
    """Own intervals between the first and the last base shared with ``other``."""
    both = chain_intersection(own, other)
    return F.when(F.size(both) == 0, empty_chain()).otherwise(
        clip(own, F.element_at(both, 1)["s"], F.element_at(both, -1)["e"])
    )


def longest_compatible(own: Column, other: Column) -> Column:
    """Longest run of shared pieces that both chains continue in the same way.

    A piece continues the run when it starts on an interval start of both
    chains and the piece before it ended on an interval end of both.
    """
    piece = "struct<s:bigint,e:bigint,open:boolean,close:boolean>"

    def shared(x: Column, y: Column) -> Column:
        s, e = F.greatest(x["s"], y["s"]), F.least(x["e"], y["e"])
        return F.when(
            s <= e,
            F.struct(
                s.alias("s"), e.alias("e"),
                (x["s"] == y["s"]).alias("open"), (x["e"] == y["e"]).alias("close"),
            ),
        )

    # an own interval without any partner breaks the run, so it stays visible as a NULL piece
    def row(x: Column) -> Column:
        hits = F.array_compact(F.transform(other, lambda y: shared(x, y)))
        return F.when(F.size(hits) == 0, F.array(F.lit(None).cast(piece))).otherwise(hits)

    pieces = F.flatten(F.transform(own, row))
    skipped = lambda a, b: F.exists(  # noqa: E731 - a template interval lies between two pieces
        other, lambda y: (y["s"] > a) & (y["e"] < b)
    )
    state = F.struct(
        empty_chain().alias("best"), _big(0).alias("best_len"),
        empty_chain().alias("run"), _big(0).alias("run_len"), F.lit(False).alias("ready"),
    )

    def step(acc: Column, x: Column) -> Column:
        last_e = F.element_at(F.when(F.size(acc["run"]) > 0, acc["run"]), -1)["e"]
        goes_on = acc["ready"] & x["open"] & ~skipped(last_e, x["s"])
        one = F.array(interval(x["s"], x["e"]))
        run = F.when(goes_on, F.concat(acc["run"], one)).otherwise(one)
        run_len = F.when(goes_on, acc["run_len"]).otherwise(_big(0)) + length(x)
        better = run_len > acc["best_len"]
        grown = F.struct(
            F.when(better, run).otherwise(acc["best"]).alias("best"),
            F.when(better, run_len).otherwise(acc["best_len"]).alias("best_len"),
            run.alias("run"), run_len.alias("run_len"), x["close"].alias("ready"),
        )
        broken = F.struct(
            acc["best"].alias("best"), acc["best_len"].alias("best_len"),
            acc["run"].alias("run"), acc["run_len"].alias("run_len"), F.lit(False).alias("ready"),
        )
        return F.when(x.isNull(), broken).otherwise(grown)

    return F.aggregate(pieces, state, step, lambda acc: acc["best"])


def phases(chain: Column, strand: Column, start_phase: Column | int = 0) -> Column:
    """Chain with the phase of each interval: ARRAY<STRUCT<s, e, phase>> in rising order."""
    first = F.lit(start_phase).cast("bigint") if isinstance(start_phase, int) else start_phase.cast("bigint")
    out = "array<struct<s:bigint,e:bigint,phase:int>>"

    def step(acc: Column, x: Column) -> Column:
        ph = F.pmod(3 - acc["n"] % 3, F.lit(3)).cast("int")
        return F.struct(
            (acc["n"] + length(x)).alias("n"),
            F.concat(acc["c"], F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), ph.alias("phase")))).alias("c"),
        )

    def run(c: Column) -> Column:
        state = F.struct(first.alias("n"), F.array().cast(out).alias("c"))
        return F.aggregate(c, state, step, lambda acc: acc["c"])

    return F.when(strand == "-", F.reverse(run(F.reverse(chain)))).otherwise(run(chain))


def phases_from(chain: Column, strand: Column, phase: Column) -> Column:
    """:func:`phases` where the first interval in transcription order has the phase ``phase`` (bases before its first whole codon)."""
    return phases(chain, strand, F.pmod(3 - phase, F.lit(3)))


def phase_at(chain: Column, strand: Column, pos: Column, start_phase: Column | int = 0) -> Column:
    """Phase of one coordinate of the chain; NULL if the chain does not cover it."""
    first = F.lit(start_phase) if isinstance(start_phase, int) else start_phase
    before_fwd = F.aggregate(
        chain, _big(0), lambda n, x: n + F.greatest(_big(0), F.least(x["e"], pos - 1) - x["s"] + 1)
    )
    before_rev = F.aggregate(
        chain, _big(0), lambda n, x: n + F.greatest(_big(0), x["e"] - F.greatest(x["s"], pos + 1) + 1)
    )
    n = F.when(strand == "-", before_rev).otherwise(before_fwd) + first
    covered = F.exists(chain, lambda x: (x["s"] <= pos) & (x["e"] >= pos))
    return F.when(covered, F.pmod(3 - n % 3, F.lit(3)).cast("int"))


def coding_chain(exons: Column, strand: Column, cds_start: Column, cds_end: Column, cds_phase: Column) -> Column:
    """Exons clipped to the coding range, its start moved by the phase, with phases assigned."""
    s = F.when(strand == "-", cds_start).otherwise(cds_start + cds_phase)
    e = F.when(strand == "-", cds_end - cds_phase).otherwise(cds_end)
    return phases(clip(exons, s, e), strand)


def _walk(chain: Column, strand: Column, offset: Column) -> Column:
    """Interval of the chain that holds the offset, counted in transcription order."""
    ordered = F.when(strand == "-", F.reverse(chain)).otherwise(chain)
    state = F.struct(offset.cast("bigint").alias("left"), F.lit(None).cast("bigint").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        n = length(x)
        here = acc["at"].isNull() & (acc["left"] < n)
        at = F.when(strand == "-", x["e"] - acc["left"]).otherwise(x["s"] + acc["left"])
        return F.struct((acc["left"] - n).alias("left"), F.when(here, at).otherwise(acc["at"]).alias("at"))

    return F.aggregate(ordered, state, step, lambda acc: acc["at"])


def to_genome(chain: Column, strand: Column, offset: Column) -> Column:
    """Transcript offset (from 0) to coordinate; past the end gives the last base."""
    last = F.when(strand == "-", chain_start(chain)).otherwise(chain_end(chain))
    return F.coalesce(_walk(chain, strand, offset), last)


def to_genome_edge(chain: Column, strand: Column, offset: Column) -> Column:
    """Border after ``offset`` bases: an offset equal to an interval's length stays on that interval."""
    ordered = F.when(strand == "-", F.reverse(chain)).otherwise(chain)
    state = F.struct(offset.cast("bigint").alias("left"), F.lit(None).cast("bigint").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        n = length(x)
        here = acc["at"].isNull() & (acc["left"] <= n)
        at = F.when(strand == "-", x["e"] + 1 - acc["left"]).otherwise(x["s"] + acc["left"])
        return F.struct((acc["left"] - n).alias("left"), F.when(here, at).otherwise(acc["at"]).alias("at"))

    last = F.when(strand == "-", chain_start(chain)).otherwise(chain_end(chain))
    return F.coalesce(F.aggregate(ordered, state, step, lambda acc: acc["at"]), last)


def first_positions(chain: Column, n: int, reverse: bool = False) -> Column:
    """First ``n`` coordinates from either end, or NULL if the chain is shorter.

    Only the outer intervals are expanded, so long chains stay cheap.
    """

    def step(acc: Column, x: Column) -> Column:
        need = F.lit(n) - F.size(acc)
        if reverse:
            seq = F.sequence(x["e"], F.greatest(x["s"], x["e"] - need + 1), F.lit(-1).cast("bigint"))
        else:
            seq = F.sequence(x["s"], F.least(x["e"], x["s"] + need - 1), F.lit(1).cast("bigint"))
        return F.when(need <= 0, acc).otherwise(F.concat(acc, seq))

    ordered = F.reverse(chain) if reverse else chain
    got = F.aggregate(ordered, F.array().cast("array<bigint>"), step)
    return F.when(F.size(got) >= n, got)


def segments(a: Column, b: Column) -> Column:
    """Partition of the union of two chains: ARRAY<STRUCT<s, e, code>>.

    code -1: only in ``a``; 1: only in ``b``; 0: in both.  A border of either
    chain always ends a segment.
    """
    both = F.concat(a, b)
    cuts = F.array_sort(
        F.array_distinct(F.concat(F.transform(both, lambda x: x["s"]), F.transform(both, lambda x: x["e"] + 1)))
    )
    n = F.greatest(F.size(cuts) - 1, F.lit(0))
    cells = F.zip_with(F.slice(cuts, F.lit(1), n), F.slice(cuts, F.lit(2), n), lambda x, y: interval(x, y - 1))

    def code(c: Column) -> Column:
        in_a = F.exists(a, lambda x: (x["s"] <= c["s"]) & (x["e"] >= c["e"]))
        in_b = F.exists(b, lambda x: (x["s"] <= c["s"]) & (x["e"] >= c["e"]))
        return F.when(in_a & in_b, 0).when(in_a, -1).when(in_b, 1)

    coded = F.transform(cells, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), code(c).cast("int").alias("code")))
    return F.filter(coded, lambda c: c["code"].isNotNull())


def segments_only(segs: Column, code: int) -> Column:
    return F.transform(F.filter(segs, lambda x: x["code"] == code), lambda x: interval(x["s"], x["e"]))


def frame_segments(a: Column, b: Column, strand: Column) -> Column:
    """:func:`segments` in transcription order; shared ones become 100 (in frame) or -100."""
    segment = "array<struct<s:bigint,e:bigint,code:int>>"
    state = F.struct(_big(0).alias("q"), _big(0).alias("t"), F.array().cast(segment).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        inframe = acc["q"] % 3 == acc["t"] % 3
        code = F.when(x["code"] == 0, F.when(inframe, 100).otherwise(-100)).otherwise(x["code"]).cast("int")
        return F.struct(
            (acc["q"] + F.when(x["code"] == -1, length(x)).otherwise(_big(0))).alias("q"),
            (acc["t"] + F.when(x["code"] == 1, length(x)).otherwise(_big(0))).alias("t"),
            F.concat(acc["out"], F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), code.alias("code")))).alias("out"),
        )

    ordered = let(segments(a, b), lambda segs: F.when(strand == "-", F.reverse(segs)).otherwise(segs))
    return F.aggregate(ordered, state, step, lambda acc: acc["out"])


METRICS = (
    "c1len", "c2len", "match_start", "match_end", "extra", "missing", "inframe", "matched", "outframe",
    "lpi", "ilpi", "mlpi",
)


def compare_metrics(a: Column, b: Column, strand: Column) -> Column:
    """Struct of comparison metrics; all -1 where one chain is empty or missing."""
    minus = strand == "-"
    same_s = (chain_start(a) == chain_start(b)).cast("bigint")
    same_e = (chain_end(a) == chain_end(b)).cast("bigint")

    def bases(framed: Column, code: int) -> Column:
        return F.aggregate(framed, _big(0), lambda n, x: n + F.when(x["code"] == code, length(x)).otherwise(_big(0)))

    def sums(framed: Column) -> Column:
        return F.struct(*[bases(framed, c).alias(n) for n, c in (("x", -1), ("m", 1), ("i", 100), ("o", -100))])

    def result(n: Column) -> Column:
        shared = n["i"] + n["o"]
        c1, c2, whole = n["x"] + shared, n["m"] + shared, n["x"] + n["m"] + shared
        values = (
            c1, c2, F.when(minus, same_e).otherwise(same_s), F.when(minus, same_s).otherwise(same_e),
            n["x"], n["m"], n["i"], shared, n["o"],
            F.floor(c1 * 100 / whole), F.floor(n["i"] * 100 / whole), F.floor(shared * 100 / whole),
        )
        return F.struct(*[v.alias(m) for v, m in zip(values, METRICS)])

    void = (F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0)
    blank = F.struct(*[_big(-1).alias(m) for m in METRICS])
    return F.when(void, blank).otherwise(let(let(frame_segments(a, b, strand), sums), result))


def cigar(chain: Column) -> Column:
    """``5M3N4M``: interval lengths and gap lengths in turn."""
    parts = F.transform(
        chain,
        lambda x, i: F.concat(
            F.when(i > 0, F.concat((x["s"] - F.get(chain, i - 1)["e"] - 1).cast("string"), F.lit("N"))).otherwise(F.lit("")),
            length(x).cast("string"),
            F.lit("M"),
        ),
    )
    return F.array_join(parts, "")


def as_text(chain: Column, empty: str = "-") -> Column:
    """``s-e,s-e``, or ``-`` for an empty chain."""
    text = F.array_join(F.transform(chain, lambda x: F.concat_ws("-", x["s"], x["e"])), ",")
    return F.when(F.coalesce(F.size(chain), F.lit(0)) <= 0, F.lit(empty)).otherwise(text)


def from_text(text: Column) -> Column:
    def one(t: Column) -> Column:
        p = F.split(t, "-")
        return interval(p[0].cast("bigint"), p[1].cast("bigint"))

    return F.when(text == "-", empty_chain()).otherwise(F.transform(F.split(text, ","), one))


def sites(chain: Column, strand: Column) -> Column:
    """Donor and acceptor of every intron: ARRAY<STRUCT<donor, acceptor>>."""
    return F.transform(
        introns(chain),
        lambda i: F.struct(
            F.when(strand == "-", i["e"]).otherwise(i["s"]).alias("donor"),
            F.when(strand == "-", i["s"]).otherwise(i["e"]).alias("acceptor"),
        ),
    )
