"""Coding chains fitted to sequences, against a plain version on lists of positions."""

from collections import defaultdict
from itertools import groupby

import pytest

from strandframe.functions.sequences import codon_table
from strandframe.plans import genome_queries as G
from strandframe.plans.catalog import QUERIES
from strandframe.plans.interval_queries import coding
from strandframe.plans.views import transcripts

SF = "/root/testdata/sf0.001"
CODONS = codon_table()
PAIR = dict(zip("ACGT", "TGCA"))


def walked(chain, strand):
    at = [p for s, e in chain for p in range(s, e + 1)]
    return at if strand == "+" else at[::-1]


def amino(text):
    return "".join(CODONS.get(text[i : i + 3], "X") for i in range(0, len(text) - 2, 3))


def fit(own, cds, strand, seq):
    """Fitted positions in transcription order, or None."""
    place = {p: j for j, p in enumerate(cds)}
    runs = [[own[0]]]
    for a, b in zip(own, own[1:]):
        if a in place and b in place and place[b] == place[a] + 1:
            runs[-1].append(b)
        else:
            runs.append([b])
    runs = [r for r in runs if r[0] in place]
    if not runs:
        return None
    cut = max(runs if strand == "+" else runs[::-1], key=len)
    if len(cut) < 3:
        return None
    first, last = place[cut[0]], place[cut[-1]]
    cut = cut[-first % 3 : len(cut) - (last + 1) % 3]
    if len(cut) < 3:
        return None
    base = lambda p: seq[p - 1 : p] if strand == "+" else PAIR.get(seq[p - 1 : p], "")
    rna = "".join(base(p) for p in own)
    at = own.index(cut[0])
    frame = amino(rna[at : at + len(cut)]).split(".")[0]
    m = max(frame.find("M"), 0)
    begin, kept = at + 3 * m, len(frame) - m
    if kept <= 0:
        return None
    stop = amino(rna[begin:]).find(".") + 1
    n = stop or kept
    ahead = amino(rna[begin % 3 : begin]).split(".")[-1]
    if cds[0] in own and own.index(cds[0]) < begin and (begin - own.index(cds[0])) % 3 == 0:
        limit = (begin - own.index(cds[0])) // 3 - 1
        ahead = ahead[len(ahead) - limit :] if limit < len(ahead) else ahead
    grown = len(ahead) - ahead.find("M") if "M" in ahead else 0
    return own[begin - 3 * grown : begin + 3 * n]


def strict(own, cds, strand, seq=None):
    """Own positions between the first and the last whole template codon that both share."""
    place = {p: j for j, p in enumerate(cds)}
    both = [i for i, p in enumerate(own) if p in place]
    if not both:
        return None
    cut = own[both[0] : both[-1] + 1]
    if len(cut) < 3:
        return None
    return cut[-place[cut[0]] % 3 : len(cut) - (place[cut[-1]] + 1) % 3]


def score(cds, fitted, strand):
    a, b = set(cds), set(fitted)
    order = sorted(a | b, reverse=strand == "-")
    runs = [(k, sum((1 if p in b else -1) if k else 1 for p in g)) for k, g in groupby(order, key=lambda p: (p in a) != (p in b))]
    frame = extra = missing = out = 0
    for k, v in runs:
        if k:
            frame, extra, missing = frame + abs(v) % 3, extra + max(-v, 0), missing + max(v, 0)
        elif frame % 3:
            out += v
    return 10 * runs[0][0] + 10 * runs[-1][0] + extra + missing + out


def transferred(rows, fitting, seqs):
    templates = {}
    for r in sorted((r for r in rows if r.is_template and r.cds), key=lambda r: (r.start, r.end, r.tid)):
        chain = tuple((x.s, x.e) for x in r.cds)
        if sum(e - s + 1 for s, e in chain) % 3 == 0:
            templates.setdefault((r.seqid, r.strand), {}).setdefault(chain, (r.start, r.end, r.tid))
    want = {}
    for r in rows:
        if r.is_template:
            continue
        own, best = walked([(x.s, x.e) for x in r.chain], r.strand), None
        for chain, first in templates.get((r.seqid, r.strand), {}).items():
            cds = walked(chain, r.strand)
            got = fitting(own, cds, r.strand, seqs[r.seqid]) if set(own) & set(cds) else None
            if got and len(got) >= 3:
                s = score(cds, got, r.strand)
                found = ((s != 0, -len(got), first), s)
                best = min(best, found) if best else found
        want[r.tid] = ("none", None, None, None) if best is None else ("imperfect" if best[0][0] else "perfect", best[0][2][2], -best[0][1], best[1])
    return want


@pytest.mark.parametrize("query, fitting", [("orf_transfer_sequence", fit), ("orf_transfer", strict)])
def test_transfer_against_positions(spark, query, fitting):
    placed = query == "orf_transfer_sequence"
    rows = coding(G._placed(spark, SF) if placed else transcripts(spark, SF)).collect()
    seqs = {str(r.doc_id): r.seq for r in G._sequences(spark, SF).collect()} if placed else defaultdict(str)
    want = transferred(rows, fitting, seqs)
    got = {r.tid: (r.kind, r.template, r.bases, r.score) for r in QUERIES[query](spark, SF).collect()}
    assert got == want and sum(w[0] != "none" for w in want.values()) > 50
