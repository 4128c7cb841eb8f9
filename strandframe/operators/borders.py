"""The best cut of all pairs of alignments of a read, many reads at a time.

What :func:`.breakpoints.score_pairs` defines pair by pair is computed here over Arrow columns: the bases of all alignments of
a batch stand one behind another, a trial's score is a difference of running sums, and only the best trial of a read is laid
out.  Reads with an alignment that lacks a value or has another length are left to the definition by rows (a NULL result).
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Bases laid out at a time.
BASES = 1 << 20
_OPS = re.compile(r"[0-9]+|[A-Za-z-]{2}")
_KINDS = {"one": pa.int32(), "two": pa.int32(), "score": pa.float64(), "cut": pa.int32(), "place1": pa.int64(), "place2": pa.int64(),
          "junction1": pa.string(), "junction2": pa.string(), "binread": pa.string()}
#: ``one`` and ``two`` are the places of the alignments in their lists.
RESULT = "struct<one:int,two:int,score:double,cut:int,place1:bigint,place2:bigint,junction1:string,junction2:string,binread:string>"


def _stretches(text: str) -> list[tuple[int, int, int, int]] | None:
    """(n, moves on read, moves on genome, score of a base) of each stretch; None where a number is too long."""
    out = []
    for o in _OPS.findall(text):
        if o[0].isdigit():
            if len(o) > 8:
                return None
            out.append((int(o), 1, 1, 1))
        else:
            out.append((1, int(o[0] != "-"), int(o[-1] != "-"), -1 if "-" in o else 0))
    return out


def _ranges(lens: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each length, one behind another."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens, lens)


def _numbers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 for NULL) as int64 and which of them are there."""
    return a.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), a.is_valid().to_numpy(zero_copy_only=False)


class _Batch:
    """Rows of one length each; ``x`` is the place of a base in its read, ``row`` its row."""

    def __init__(self, lens: np.ndarray):
        self.lens, self.n = lens, len(lens)
        self.off = np.cumsum(lens) - lens
        self.size = int(lens.sum())
        self.row, self.x = np.repeat(np.arange(self.n), lens), _ranges(lens)

    def spread(self, row: np.ndarray, x: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Sums of the values at places of reads; what lies behind a read's end is left out."""
        inside = x < self.lens[row]
        return np.rint(np.bincount(self.off[row[inside]] + x[inside], weights=value[inside], minlength=self.size)).astype(np.int64)


class _Way:
    """One alignment of each row, read in one direction."""

    def __init__(self, b: _Batch, runs: tuple[np.ndarray, ...], first: np.ndarray, start: np.ndarray, step: np.ndarray):
        self.b, self.first, self.start, self.step = b, first, start, step
        row, n, r, g, s = runs
        ahead = np.cumsum(n * r) - n * r
        begins = np.searchsorted(row, np.arange(b.n))
        q = np.zeros(0, np.int64) if not len(row) else first[row] + ahead - ahead[begins[row]]
        took = r == 1
        lo, hi = np.minimum(q, b.lens[row]), np.minimum(q + n, b.lens[row])
        # a stretch raises the score where it begins and lowers it behind its end
        edge = b.off[row] + row
        change = np.bincount((edge + lo)[took], weights=s[took], minlength=b.size + b.n) - np.bincount((edge + hi)[took], weights=s[took], minlength=b.size + b.n)
        laid = np.cumsum(np.rint(change).astype(np.int64))
        bases = laid[np.arange(b.size) + b.row]
        lone = ~took
        if lone.any():
            bases = bases + b.spread(row[lone], q[lone], s[lone])
        self.bases, self.sums = bases, np.concatenate([[0], np.cumsum(bases)])
        shifts = g != r
        self.gapped = np.zeros(b.n, bool)
        self.gapped[row[shifts]] = True
        if shifts.any():
            moved = b.spread(row[shifts], q[shifts], (g - r)[shifts])
            before = np.cumsum(moved) - moved
            self.u = b.x - first[b.row] + before - before[b.off][b.row]
            gone = shifts & (g == 0)
            self.lacks = b.spread(row[gone], q[gone] + 1, np.ones(int(gone.sum()))) > 0

    def upto(self, row: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Sum of the first x bases."""
        at = self.b.off[row]
        return self.sums[at + x] - self.sums[at]

    def places(self, row: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Genome positions of borders, and which of them there are."""
        there = (x >= 0) & (x < self.b.lens[row])
        u = x - self.first[row]
        if self.gapped.any():
            at = np.where(there, self.b.off[row] + x, 0)
            u, there = self.u[at], there & ~self.lacks[at]
        return self.start[row] + self.step[row] * u, there

    def marks(self, row: np.ndarray, pos: np.ndarray, known: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, border, label) of sites that stand at a border, in read order."""
        u = (pos - self.start[row]) * self.step[row]
        i = self.first[row] + u
        if self.gapped.any():
            b, odd = self.b, self.gapped[row]
            has = np.flatnonzero(self.gapped[b.row] & ~self.lacks)
            far = int(np.abs(self.u).max()) + 1
            keys = b.row[has] * (2 * far + 1) + self.u[has] + far
            asked = row[odd] * (2 * far + 1) + u[odd] + far
            at = np.searchsorted(keys, asked)
            hit = np.abs(u[odd]) <= far
            hit[hit] = (at[hit] < len(keys)) & (keys[np.minimum(at[hit], len(keys) - 1)] == asked[hit]) if len(keys) else False
            i[odd] = np.where(hit, b.x[has[np.minimum(at, len(keys) - 1)]] if len(keys) else -1, -1)
        ok = known & (i >= 0) & (i < self.b.lens[row])
        row, i, label = row[ok], i[ok], label[ok]
        order = np.lexsort((i, row))
        return row[order], i[order], label[order]


def _picked(marks: tuple[np.ndarray, ...], n: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The marks of the alignments ``which``, with their place in it as row."""
    row, i, label = marks
    count = np.bincount(row, minlength=n)
    mine, at = count[which], (np.cumsum(count) - count)[which]
    to = np.repeat(np.arange(len(which)), mine)
    at = at[to] + _ranges(mine)
    return to, i[at], label[at]


def _trials(left: _Way, right: _Way, p: np.ndarray, q: np.ndarray, donors, acceptors, cut: np.ndarray, full: int, half: int):
    """[pair, cut, bases kept of ``left``, weights between, sum, label 1, label 2, number in the pair] of all trials of one order.

    Pair k is alignment p[k] of ``left`` and q[k] of ``right``; ``donors`` and ``acceptors`` have pairs as rows.
    """
    every, none = np.arange(len(p)), lambda k: np.full(k, -1)
    (dr, di, dl), (ar, ai, al) = donors, acceptors
    lens = left.b.lens[p]
    wide = int(lens.max()) + 2
    lo, hi = np.searchsorted(ar * wide + ai, dr * wide + di + 1), np.searchsorted(ar * wide + ai, dr * wide + di + 1, "right")
    d = np.repeat(np.arange(len(dr)), hi - lo)
    a = np.repeat(lo, hi - lo) + _ranges(hi - lo)
    parts = ((every, cut, cut, 0, none(len(p)), none(len(p))), (dr[d], di[d], di[d], 2, dl[d], al[a]), (dr, di, di, 1, dl, none(len(dr))), (ar, ai, ai + 1, 0, none(len(ar)), al))
    whole = right.upto(q, lens)
    before, out = np.zeros(len(p), np.int64), []
    for row, at, kept, weights, one, two in parts:
        total = left.upto(p[row], kept) + (0, half, 2 * full)[weights] + whole[row] - right.upto(q[row], np.minimum(kept + weights, lens[row]))
        n = np.bincount(row, minlength=len(p))
        nth = before[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
        out.append((row, at, kept, np.full(len(row), weights), total, one, two, nth))
        before += n
    return [np.concatenate(c) for c in zip(*out, strict=True)], before


def _texts(rows: np.ndarray, values: np.ndarray) -> pa.Array:
    """So many values a row, written without anything between."""
    kinds, which = np.unique(values, return_inverse=True)
    words = [str(v).encode() for v in kinds.tolist()]
    lens = np.array([len(w) for w in words])
    table = np.array([list(w.ljust(max(lens), b" ")) for w in words], np.uint8)
    each = lens[which]
    at = np.cumsum(each) - each
    chars = np.empty(int(each.sum()), np.uint8)
    for c in range(int(max(lens))):
        long = each > c
        chars[at[long] + c] = table[which[long], c]
    ends = np.concatenate([at[np.cumsum(rows) - rows], [len(chars)]])
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(chars.tobytes()))


def _best(sides: list[dict], n: int, full: int, half: int) -> dict[str, pa.Array]:
    """The best trial of each of ``n`` reads, over all pairs, both directions and both orders."""
    counts = [np.bincount(s["read"], minlength=n) for s in sides]
    read = np.repeat(np.arange(n), counts[0] * counts[1])
    k = _ranges(counts[0] * counts[1])
    p = (np.cumsum(counts[0]) - counts[0])[read] + k // counts[1][read]
    q = (np.cumsum(counts[1]) - counts[1])[read] + k % counts[1][read]
    lens = sides[0]["batch"].lens[p]
    ends = np.cumsum(lens)
    at, x = np.repeat(np.arange(len(p)), lens), _ranges(lens)
    found = []
    for way in (0, 1):
        one, two = (s["ways"][way] for s in sides)
        marks = [{c: _picked(w.marks(*s[c]), s["batch"].n, pairs) for c in ("donors", "acceptors")} for s, w, pairs in zip(sides, (one, two), (p, q), strict=True)]
        gain = one.sums[(one.b.off[p])[at] + x] - two.sums[(two.b.off[q])[at] + x]
        ties = gain == np.maximum.reduceat(gain, ends - lens)[at]
        cut = np.add.reduceat(np.where(ties, x, 0), ends - lens) // np.add.reduceat(ties.astype(np.int64), ends - lens)
        straight, before = _trials(one, two, p, q, marks[0]["donors"], marks[1]["acceptors"], cut, full, half)
        crossed, _ = _trials(two, one, q, p, marks[1]["donors"], marks[0]["acceptors"], cut, full, half)
        crossed[-1] = crossed[-1] + before[crossed[0]]
        found += [[*straight, np.full(len(straight[0]), way), np.zeros(len(straight[0]), bool)], [*crossed, np.full(len(crossed[0]), way), np.ones(len(crossed[0]), bool)]]
    pair, total = (np.concatenate([f[c] for f in found]) for c in (0, 4))
    most = np.full(n, np.iinfo(np.int64).min)
    np.maximum.at(most, read[pair], total)
    top = np.flatnonzero(total == most[read[pair]])
    pair, cut, kept, weights, total, label1, label2, nth, way, crossed = (np.concatenate(c)[top] for c in zip(*found, strict=True))
    order = np.lexsort((nth, way, pair))  # pairs are numbered read by read, in the order of lines
    order = order[np.searchsorted(read[pair][order], np.arange(n))]
    pair, cut, kept, weights, total, label1, label2, way, crossed = (v[order] for v in (pair, cut, kept, weights, total, label1, label2, way, crossed))

    lens, mine = lens[pair], (p[pair], q[pair])
    ends = np.cumsum(lens)
    at, x = np.repeat(np.arange(n), lens), _ranges(lens)
    laid, places = [], []
    for s, w, c in zip(sides, mine, (cut, cut - 1), strict=True):
        base = s["batch"].off[w][at] + x
        laid.append(np.where(way[at] == 0, s["ways"][0].bases[base], s["ways"][1].bases[base]))
        both = [v.places(w, c) for v in s["ways"]]
        places.append(pa.array(np.where(way == 0, both[0][0], both[1][0]), mask=~np.where(way == 0, both[0][1], both[1][1])))
    vector = np.where((x < kept[at]) != crossed[at], *laid)
    for c in (0, 1):
        put = (weights > c) & (kept + c < lens)
        vector[(ends - lens + kept + c)[put]] = np.where(weights == 2, full, half)[put]
    genes = {c: pa.concat_arrays([s["genes"][c] for s in sides]) for c in ("donors", "acceptors")}
    name = lambda c, v: genes[c].take(pa.array(np.maximum(v, 0), mask=v < 0))
    return {
        "one": pa.array(sides[0]["place"][mine[0]]), "two": pa.array(sides[1]["place"][mine[1]]), "score": pa.array(total / lens), "cut": pa.array(cut),
        "place1": places[0], "place2": places[1], "junction1": name("donors", label1), "junction2": name("acceptors", label2), "binread": _texts(lens, vector),
    }


def _runs_of(codes: np.ndarray, texts: list, backwards: bool) -> tuple[np.ndarray, ...]:
    """(row, n, r, g, s) of the stretches of all rows; ``codes`` says which of the texts a row has."""
    lens = np.array([len(t) for t in texts], np.int64)
    flat = np.array([x for t in texts for x in t], np.int64).reshape(-1, 4)
    mine, at = lens[codes], (np.cumsum(lens) - lens)[codes]
    row, x = np.repeat(np.arange(len(codes)), mine), _ranges(mine)
    picked = flat[at[row] + (mine[row] - 1 - x if backwards else x)]
    return row, *picked.T


def _column(rows: pa.StructArray, name: str) -> pa.Array:
    return rows.flatten()[rows.type.get_field_index(name)]


def _side(lists: pa.ListArray) -> tuple[dict, np.ndarray, np.ndarray]:
    """The alignments in the lists, a length for each list, and which lists can be taken.

    Entries that differ only in their sites, one behind another, are one alignment.
    """
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows, read = lists.flatten(), np.repeat(np.arange(len(lists)), size)
    numbers = [_numbers(_column(rows, c)) for c in ("qlen", "qstart", "qend", "sstart", "send")]
    coded = {c: _column(rows, c).dictionary_encode() for c in ("btop", "sseqid")}
    texts = [_stretches(t) for t in coded["btop"].dictionary.to_pylist()]
    codes = {c: v.indices.fill_null(len(v.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64) for c, v in coded.items()}
    good = np.array([t is not None for t in texts] + [False])[codes["btop"]] & (codes["sseqid"] < len(coded["sseqid"].dictionary))
    for _, there in numbers:
        good &= there
    for c in ("donors", "acceptors"):
        good &= _column(rows, c).is_valid().to_numpy(zero_copy_only=False)
    qlen, qstart, qend = (v for v, _ in numbers[:3])
    good &= (qlen > 0) & (qlen < 2**31) & (qstart > 0) & (qend <= qlen)
    new = np.ones(len(read), bool)
    new[1:] = np.any([v[1:] != v[:-1] for v in (read, *[v for v, _ in numbers], *codes.values())], axis=0)
    long = np.zeros(len(lists), np.int64)
    long[read] = qlen
    good &= qlen == long[read]
    fine = (size > 0) & (np.bincount(read[~good], minlength=len(lists)) == 0)
    return {"rows": rows, "read": read, "new": new, "numbers": [v for v, _ in numbers], "codes": codes["btop"], "texts": [t or [] for t in texts], "begin": np.cumsum(size) - size}, long, fine


def _laid(found: dict, fine: np.ndarray, number: dict[str, int]) -> dict:
    """Alignments of the lists taken (renumbered): both reading directions and sites; ``number`` counts the sites."""
    renumbered = np.cumsum(fine) - 1
    mine = fine[found["read"]]
    entry = np.flatnonzero(mine)
    first = np.flatnonzero(mine & found["new"])
    alignment = np.cumsum(found["new"][entry]) - 1
    qlen, qstart, qend, sstart, send = (v[first] for v in found["numbers"])
    b, step = _Batch(qlen), np.where(sstart < send, 1, -1)
    turns = ((qstart - 1, sstart, step), (qlen - qend, send, -step))
    side = {"batch": b, "read": renumbered[found["read"][first]], "place": first - found["begin"][found["read"][first]], "genes": {}}
    side["ways"] = [_Way(b, _runs_of(found["codes"][first], found["texts"], bool(w)), *turn) for w, turn in enumerate(turns)]
    for c in ("donors", "acceptors"):
        lists = _column(found["rows"], c).take(pa.array(entry))
        sites, row = lists.flatten(), np.repeat(alignment, lists.value_lengths().to_numpy(zero_copy_only=False))
        pos, known = _numbers(_column(sites, "pos"))
        side["genes"][c] = _column(sites, "gene")
        side[c] = (row, pos, known, np.arange(len(row)) + number[c])
        number[c] += len(row)
    return side


def best_cuts(full: int, half: int) -> Callable[..., pa.Array]:
    """A function of two Arrow columns: the alignments of a read to one and to the other genome, in the order of their lines."""
    kinds = [pa.field(c, t) for c, t in _KINDS.items()]

    def some(one: pa.ListArray, two: pa.ListArray) -> pa.Array:
        (a, long, fine), (b, other, fine2) = _side(one), _side(two)
        fine = fine & fine2 & (long == other)
        if not fine.any():
            return pa.nulls(len(one), pa.struct(kinds))
        number = {"donors": 0, "acceptors": 0}
        found = _best([_laid(a, fine, number), _laid(b, fine, number)], int(fine.sum()), full, half)
        index = pa.array(np.maximum(np.cumsum(fine) - 1, 0), mask=~fine)
        return pa.StructArray.from_arrays([found[c].cast(t).take(index) for c, t in _KINDS.items()], fields=kinds, mask=pa.array(~fine))

    def run(one: pa.Array, two: pa.Array) -> pa.Array:
        work = one.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) * two.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        _, long, _ = _side(one)
        done = np.cumsum(np.maximum(work * long, 1))
        out, at = [pa.nulls(0, pa.struct(kinds))], 0
        while at < len(done):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + BASES, "right")))
            out.append(some(one.slice(at, to - at), two.slice(at, to - at)))
            at = to
        return pa.concat_arrays(out)

    return run
