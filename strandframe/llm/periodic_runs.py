"""Periodic runs of words: stretches whose words repeat at a smallest distance q over at least three periods.

The texts of a batch are one sequence of word numbers, with a number of its own behind every text, so that all steps are
array operations and no run crosses a border.

1. Short periods (up to ``DIRECT``): direct lag scans, word i against word i + q.
2. Longer periods: scales.  A scale has a block length l; its minimizers are the positions whose hash of l words is the
   smallest in some window of w positions.  A scale is used for the periods q with q <= l and w + l <= 2q + 1.  Within a run
   of at least 3q words the first window and the one q further on lie inside the run and hold the same hashes, so their
   minima stand q apart; between them no equal hash stands, as a block of l >= q words that repeats at a distance d < q
   inside the run would give it the smaller period gcd(d, q).  Neighbours among equal minimizers therefore hold a seed
   for every run, and there are no more neighbours than minimizers.
3. Seeds at a distance that the scale is used for are extended word by word in both directions.  A stretch found with
   several distances keeps the smallest: by Fine and Wilf's theorem the others are its multiples.

The hash only chooses positions; every run is compared word by word.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words and so many periods.
SHORTEST, PERIODS = 24, 3
#: The longest period that is scanned for directly.
DIRECT = 12
#: Bytes of text taken at once; a longer text is taken alone.
TOGETHER = 4 << 20

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

Run = tuple[int, int, int]  # start, length, period


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(shortest period, block length = longest period, window) for periods from DIRECT + 1 up to ``longest``."""
    q = DIRECT + 1
    while q <= longest:
        block = max(q, 3 * q // 2)
        yield q, block, 2 * q + 1 - block
        q = block + 1


def _sliding(values: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """``pick`` over all windows of ``width`` by doubling."""
    out, have = values, 1
    while 2 * have <= width:
        out, have = pick(out[:-have], out[have:]), 2 * have
    return pick(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def _mixed(a: np.ndarray) -> np.ndarray:
    """Scattered 64-bit values of word numbers."""
    x = (a.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions whose hash is the smallest in one of the windows that hold it, ties included."""
    low = _sliding(hashes, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    reach = _sliding(np.concatenate([edge, low, edge]), width, np.maximum)
    return np.flatnonzero(hashes == reach)


def _prefix(a: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of value times base^i, and base^-i."""
    powers = np.full(len(a), base, np.uint64)
    powers[:1] = 1
    inverse = np.full(len(a), pow(base, -1, 1 << 64), np.uint64)
    inverse[:1] = 1
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_mixed(a) * np.multiply.accumulate(powers), out=sums[1:])
    return sums, np.multiply.accumulate(inverse)


def _stretches(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of consecutive numbers."""
    cut = np.flatnonzero(np.diff(places) != 1)
    return places[np.concatenate([[0], cut + 1])], places[np.concatenate([cut, [len(places) - 1]])]


def _reach(a: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and j on (or backwards) agree."""
    n = 0
    width = 64
    while True:
        if step > 0:
            x, y = a[i + n : i + n + width], a[j + n : j + n + width]
        else:
            lo = max(0, i - n - width + 1)
            x, y = a[lo : i - n + 1][::-1], a[j - n - (i - n - lo) : j - n + 1][::-1]
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[:m] != y[:m])
        if len(differ):
            return n + int(differ[0])
        n += m
        if m < width:
            return n
        width *= 2


def _direct(a: np.ndarray) -> Iterator[Run]:
    for q in range(1, min(DIRECT, len(a) - 1) + 1):
        same = np.flatnonzero(a[:-q] == a[q:])
        if len(same):
            first, last = _stretches(same)
            long = last - first + 1 + q >= max(SHORTEST, PERIODS * q)
            yield from ((int(s), int(e - s + 1 + q), q) for s, e in zip(first[long], last[long]))


def _seeded(a: np.ndarray, lengths: np.ndarray) -> Iterator[Run]:
    """Runs of longer periods; at each scale only of texts that are long enough for it."""
    starts = np.cumsum(lengths + 1) - lengths - 1
    part, where, texts = a, np.arange(len(a)), len(lengths)
    sums = inverse = None
    for shortest, block, width in scales(int(lengths.max(initial=0)) // PERIODS):
        long = np.flatnonzero(lengths >= PERIODS * shortest)
        if sums is None or 2 * len(long) < texts:
            keep = np.concatenate([np.arange(starts[t], starts[t] + lengths[t] + 1) for t in long]) if len(long) else np.zeros(0, np.int64)
            part, where, texts = a[keep], keep, len(long)
            sums, inverse = _prefix(part, _ODD)
        if len(part) < block + width:
            return
        hashes = (sums[block:] - sums[:-block]) * inverse[: len(part) - block + 1]
        chosen = _minimizers(hashes, width)
        of = hashes[chosen]
        order = np.argsort(of, kind="stable")
        p, near = chosen[order][:-1], chosen[order][1:]
        q = near - p
        fit = (of[order][:-1] == of[order][1:]) & (q >= shortest) & (q <= block)
        # Of seeds within a run found before with their distance none is extended again.
        done: dict[int, int] = {}
        for q, p in sorted(zip(q[fit].tolist(), p[fit].tolist())):
            if p < done.get(q, -1):
                continue
            ahead = _reach(part, p, p + q, 1)
            back = _reach(part, p - 1, p + q - 1, -1) if p else 0
            done = {q: p + ahead}
            if ahead + back + q >= max(SHORTEST, PERIODS * q):
                yield int(where[p - back]), ahead + back + q, q


def runs_of(a: np.ndarray, lengths: np.ndarray) -> list[Run]:
    """All runs of a batch of texts, by start, then period.  ``a``: word numbers, behind every text one that stands nowhere else."""
    best: dict[tuple[int, int], int] = {}
    for start, length, q in itertools.chain(_direct(a), _seeded(a, lengths)):
        best[start, length] = min(q, best.get((start, length), q))
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def covered(n: int, runs: list[Run]) -> np.ndarray:
    """Words that a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def strongest(runs: list[Run]) -> Run | None:
    """Of the greatest exact length / period the first, then the one with the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapsed(texts: list[bytes], rewrite: Callable[[int, int], np.ndarray | None] | None = None) -> Iterator[tuple[list[Run], bytes]]:
    """For each text its runs and its words, joined by one space, without the repeated ones.

    ``rewrite(t, n)`` may give the places of text t from which its n words are taken instead.
    """
    numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
    words = [t.split() for t in texts]
    found = []
    for t, ws in enumerate(words):
        a = np.fromiter(map(numbers.__getitem__, ws), np.int32, len(ws))
        taken = rewrite(t, len(ws)) if rewrite else None
        if taken is not None:
            a, words[t] = a[taken], [ws[i] for i in taken.tolist()]
        found.append(a)
    lengths = np.array([len(a) for a in found], np.int64)
    flat = np.concatenate([x for t, a in enumerate(found) for x in (a, np.array([-1 - t], np.int32))]) if found else np.zeros(0, np.int32)
    starts = np.cumsum(lengths + 1) - lengths - 1
    runs: list[list[Run]] = [[] for _ in words]
    for s, n, q in runs_of(flat, lengths):
        t = int(np.searchsorted(starts, s, "right")) - 1
        runs[t].append((s - int(starts[t]), n, q))
    for ws, rs in zip(words, runs):
        kept = ws if not rs else list(itertools.compress(ws, (~covered(len(ws), rs)).tolist()))
        yield rs, b" ".join(kept)


def planted(doc_id, n: int) -> np.ndarray | None:
    """Where the words of a text come from if the check plants a run in it: from place a on with period p; None: nowhere."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


_SCHEMA = pa.schema([("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
                     ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of about TOGETHER bytes of text; the text is the last column."""
    texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    held = (np.cumsum(sizes) - sizes) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(sizes)] if len(sizes) else [0]
    for a, b in itertools.pairwise(cuts):
        yield batch.slice(a, b - a), [t or b"" for t in texts.slice(a, b - a).to_pylist()]


def _digests(rewritten: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in it:
            for rows, texts in _portions(batch):
                ids = rows.column(0).to_pylist()
                out = []
                for runs, kept in collapsed(texts, (lambda t, n: planted(ids[t], n)) if rewritten else None):
                    top = strongest(runs)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                    out.append((len(runs), *(top or (None, None, None)), top and 1000 * top[1] // top[2], sha(listed), sha(kept)))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), _SCHEMA.types)]
                yield pa.RecordBatch.from_arrays([rows.column(0), *columns], names=["id", *_SCHEMA.names])

    return run


def _texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for rows, texts in _portions(batch):
            got = list(collapsed(texts))
            spans = pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs, _ in got], _SPANS)
            yield pa.RecordBatch.from_arrays([rows.column(0), spans, pa.array([k.decode() for _, k in got])], names=["id", "runs", "collapsed"])


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, runs (array of start, length, period; words count from 0), collapsed (the text without repeated periods).

    Words are what ASCII white space separates; a null text has none.  Every row is judged by itself, so repeated rows and
    null ids give a row each.  Other columns are ignored; an empty table gives no row.
    """
    rows = _narrow(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_texts, f"id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def run_digests(docs: DataFrame, rewritten: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_runs, start, length, period and exponent_milli of the strongest run, and digests.

    ``rewritten`` first plants a run in about a tenth of the texts (see ``planted``).  Without a run the four numbers are null.
    A null id plants nothing.  The rest is as in ``collapse_runs``.
    """
    rows = _narrow(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    numbers = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _SCHEMA)
    return rows.mapInArrow(_digests(rewritten), f"id {kind}, {numbers}").withColumnRenamed("id", id_col)
