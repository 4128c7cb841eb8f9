"""Nucleotide sequence functions (JVM-side)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chains import let

# The standard genetic code in TCAG order ("." is a stop) and the
# IUPAC ambiguity codes.
BASES = "TCAG"
AMINO = "FFLLSSSSYY..CC.WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
COMPLEMENT_FROM = "ACGTRYSWKMBDHVNacgtryswkmbdhvn"
COMPLEMENT_TO = "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"


def codon_table() -> dict[str, str]:
    """Codon -> amino acid, with every ambiguous codon whose expansions agree."""
    plain = {"".join(c): AMINO[i] for i, c in enumerate(product(BASES, repeat=3))}
    table = {}
    for codon in product(IUPAC, repeat=3):
        found = {plain["".join(c)] for c in product(*[IUPAC[b] for b in codon])}
        if len(found) == 1:
            table["".join(codon)] = found.pop()
    return table | {"NNN": "X", "XXX": "X", "RAY": "B", "SAR": "Z"}


_CODONS = codon_table()


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO))


def codons(seq: Column) -> Column:
    """Whole codons of a sequence as an array, in one pass over the text."""
    return F.regexp_extract_all(F.upper(seq), F.lit("(.{3})"), F.lit(1))


def translate(seq: Column) -> Column:
    """Protein text of the whole codons of a sequence; unknown codons give X.

    Plain codons are looked up by position; only ambiguous ones search the table.
    """
    amino = F.array(*[F.lit(a) for a in AMINO])
    table = F.create_map(*[F.lit(x) for kv in sorted(_CODONS.items()) if set(kv[0]) - set(BASES) for x in kv])

    def index(c: Column, i: int) -> Column:
        return F.position(F.substring(c, i, 1), F.lit(BASES)) - 1

    def one(c: Column) -> Column:
        a, b, d = index(c, 1), index(c, 2), index(c, 3)
        plain = (a >= 0) & (b >= 0) & (d >= 0)
        return F.when(plain, F.get(amino, a * 16 + b * 4 + d)).otherwise(F.coalesce(F.try_element_at(table, c), F.lit("X")))

    return F.array_join(F.transform(codons(seq), one), "")


def is_full_orf(aa: Column, nt: Column) -> Column:
    """Starts with M, ends with the only stop, whole codons."""
    return (F.length(nt) % 3 == 0) & aa.rlike(r"^M[^.]*\.$")


def spliced(seq: Column, chain: Column, strand: Column, origin: Column | int = 1) -> Column:
    """Sequence of a chain; ``origin`` is the coordinate of the first base of ``seq``."""
    origin = F.lit(origin) if isinstance(origin, int) else origin
    fwd = F.array_join(
        F.transform(chain, lambda x: F.substring(seq, (x["s"] - origin + 1).cast("int"), (x["e"] - x["s"] + 1).cast("int"))), ""
    )
    return F.when(strand == "-", reverse_complement(fwd)).otherwise(fwd)


def ambiguity(seq: Column) -> Column:
    """Fraction of characters other than ACGT."""
    other = F.length(F.regexp_replace(seq, "[ACGTacgt]", ""))
    return F.when(F.length(seq) > 0, other / F.length(seq))


def passes_quality(
    seq: Column,
    min_len: int = 0,
    max_len: int = 2**31 - 1,
    max_ambiguity: float = 1.0,
    alphabet: str | None = None,
) -> Column:
    n = F.length(seq)
    ok = (n > 0) & (n >= min_len) & (n <= max_len) & (ambiguity(seq) <= max_ambiguity)
    return ok if alphabet is None else ok & seq.rlike(f"^[{alphabet}]*$")


# The codons that open and close a reading frame.
START, STOPS = "ATG", ("TAA", "TAG", "TGA")


def longest_orfs(seq: Column) -> Column:
    """All longest open reading frames of a sequence (start codon to the first stop in frame), as offsets from 0, overlaps included.

    Each of the three frames is cut into codons once; of these only starts and stops are folded, with the first open start
    carried along.  A start behind another open one never gives a longest frame.
    """
    state = F.struct(F.lit(-1).alias("open"), F.lit(0).alias("best"), F.array().cast("array<int>").alias("at"))

    def frame(f: int) -> Column:
        cut = F.regexp_extract_all(F.substring(F.coalesce(seq, F.lit("")), f + 1, 2**31 - 1), F.lit("(?s)(.{3})"), F.lit(1))
        kind = lambda c: F.when(c == START, 1).when(c.isin(*STOPS), 2).otherwise(0)
        marks = F.filter(F.transform(cut, lambda c, i: F.struct(i.alias("i"), kind(c).alias("kind"))), lambda m: m["kind"] > 0)

        def step(acc: Column, m: Column) -> Column:
            n = (m["i"] - acc["open"] + 1) * 3
            closes = (m["kind"] == 2) & (acc["open"] >= 0)
            here = F.array(acc["open"] * 3 + f)
            at = F.when(closes & (n > acc["best"]), here).when(closes & (n == acc["best"]), F.concat(acc["at"], here)).otherwise(acc["at"])
            return F.struct(
                F.when(m["kind"] == 2, -1).when(acc["open"] < 0, m["i"]).otherwise(acc["open"]).alias("open"),
                F.when(closes, F.greatest(n, acc["best"])).otherwise(acc["best"]).alias("best"), at.alias("at"),
            )

        return F.aggregate(marks, state, step, lambda acc: F.struct(acc["best"].alias("best"), acc["at"].alias("at")))

    def longest(frames: Column) -> Column:
        best = F.array_max(F.transform(frames, lambda x: x["best"]))
        starts = F.array_sort(F.flatten(F.transform(F.filter(frames, lambda x: x["best"] == best), lambda x: x["at"])))
        return F.transform(starts, lambda s: F.struct(s.cast("bigint").alias("s"), (s + best - 1).cast("bigint").alias("e")))

    return let(F.array(*[frame(f) for f in range(3)]), longest)


def splice_consensus(donor: Column, acceptor: Column) -> Column:
    """Donor/acceptor base pairs GT-AG, GC-AG and AT-AC (already on the transcript strand)."""
    return F.concat_ws("-", F.upper(donor), F.upper(acceptor)).isin("GT-AG", "GC-AG", "AT-AC")


def stop_codon_shift(chain: Column, strand: Column, bases: int = 3) -> Column:
    """Grow (bases > 0) or shrink (bases < 0) the 3' end of a chain within its last interval."""
    n = F.size(chain)
    return F.transform(
        chain,
        lambda x, i: F.struct(
            F.when((strand == "-") & (i == 0), x["s"] - bases).otherwise(x["s"]).alias("s"),
            F.when((strand != "-") & (i == n - 1), x["e"] + bases).otherwise(x["e"]).alias("e"),
        ),
    )
