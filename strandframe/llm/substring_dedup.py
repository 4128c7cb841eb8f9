"""Removal of repeated passages: a count-min prefilter, then exact grouping of what it lets through.

A window is ``size`` consecutive words of one text.  Windows are compared by 128 bits: two polynomials over the words' 128-bit
XXH3 hashes, position by position.  Texts are handled in *chunks* of a source (about ``CHUNK`` bytes, at least one text).

1. Every chunk builds its part of a count-min sketch.  The sketch has about 32 cells for a window of the whole input, so
   a part is sparse; it travels as sorted Golomb-coded cells with a bit for cells counted twice, each range of cells to
   its owner.  Owners add the parts up and answer each chunk with the cells whose merged count is two or more.  A count
   is never too low, so no repeated window is lost; about one unique window in 30 is let through.
2. Chunks send the distinct 128-bit values of the windows let through to owners, which group them exactly and answer
   with the repeated ones.
3. Chunks mark the words that a repeated window covers and drop them.

Only packed numbers are shuffled, never texts or rows for each window.  A window that stands in a third of all texts is one
entry for a chunk.  Every pass must see the same chunks: the layout of the scan is pinned and a checksum of each chunk is
compared, so a table that changes between passes ends in an error, not in a wrong result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain, compress, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tools

#: Text bytes of a chunk.
CHUNK = 8 << 20
#: Sketch cells for each byte of text (a word takes five or six).
CELLS_PER_BYTE = 6
#: Text bytes for which one owner takes the windows.
PER_OWNER = 16 << 20
#: Words whose windows are formed together (at least one text).
PORTION = 1 << 17
#: Words whose hashes a task remembers; a matter of speed only.
REMEMBERED = 1 << 20

_SENT = pa.schema([("src", pa.int32()), ("chunk", pa.int32()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()),
                   ("a", pa.binary()), ("b", pa.binary()), ("flags", pa.binary())])
_DDL = "src int, chunk int, owner int, n int, k int, a binary, b binary, flags binary"


class _Numbers(dict):
    """word -> its number in two tables of 64-bit hashes, remembered."""

    def __init__(self):
        self.halves = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        d = xxhash.xxh3_128_intdigest(word)
        self.halves[0].append(d >> 64)
        self.halves[1].append(d & 0xFFFFFFFFFFFFFFFF)
        self[word] = n = len(self)
        return n

    def room(self) -> None:
        """Forget everything if there is too much; numbers hold until the next call."""
        if len(self) >= REMEMBERED:
            self.clear()
            self.halves = array("Q"), array("Q")


#: Fixed odd numbers, 5 modulo 8: a window's halves are the values at them of the polynomial that its words' hashes make up.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4D)


def _window_keys(texts: list[list[bytes]], size: int, numbers: _Numbers) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of every window's value, text after text; from prefix sums, so their cost does not grow with ``size``."""
    numbers.room()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    cut = np.flatnonzero(np.diff(np.cumsum(lengths) // PORTION)) + 1
    parts = [_portion_keys(texts[i:j], lengths[i:j], size, numbers) for i, j in pairwise([0, *cut.tolist(), len(texts)])]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _portion_keys(texts: list[list[bytes]], lengths: np.ndarray, size: int, numbers: _Numbers) -> list[np.ndarray]:
    total = int(lengths.sum())
    ids = np.fromiter(chain.from_iterable(map(numbers.__getitem__, ws) for ws in texts), np.int64, total)
    at = np.flatnonzero(np.arange(size, total + size) <= np.repeat(np.cumsum(lengths), lengths))
    out = []
    for table, base in zip(numbers.halves, _BASES):
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum(np.array(table, np.uint64)[ids] * _powers(base, total), out=sums[1:])
        value = (sums[at + size] - sums[at]) * _powers(pow(base, -1, 1 << 64), total)[at]
        value ^= value >> np.uint64(31)
        value *= np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        out.append(value)
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _chunks(it: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list[tuple[pa.RecordBatch, int]], list[list[bytes]]]]:
    """(chunk, [(batch, row)], words of each text)."""
    held, words, size, k = [], [], 0, 0
    for batch in it:
        for i, text in enumerate(tools.utf8(batch.column("body"))):
            held.append((batch, i))
            words.append(text.split())
            size += len(text)
            if size >= limit:
                yield k, held, words
                held, words, size, k = [], [], 0, k + 1
    if held:
        yield k, held, words


def _cells(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - bits)


def _starts(bits: int, owners: int) -> np.ndarray:
    return np.array([(o << bits) // owners for o in range(owners)], np.uint64)


def _check(src: int, chunk: int, keys: np.ndarray) -> dict:
    """A row to owner -1, which stays unanswered: the checksum of a chunk."""
    total = int(keys.sum(dtype=np.uint64)) if len(keys) else 0
    return {"src": src, "chunk": chunk, "owner": -1, "n": len(keys), "k": 0, "a": total.to_bytes(8, "big"), "b": b"", "flags": b""}


def _send_cells(size: int, bits: int, owners: int, limit: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            src, numbers, starts = tools.source(), _Numbers(), _starts(bits, owners)
            for chunk, _, words in _chunks(it, limit):
                keys, _ = _window_keys(words, size, numbers)
                yield _check(src, chunk, keys)
                cells, counts = np.unique(_cells(keys, bits), return_counts=True)
                cuts = [*np.searchsorted(cells, starts).tolist(), len(cells)]
                for o, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    if i < j:
                        k, a, b = tools.rice_pack(cells[i:j] - starts[o])
                        yield {"src": src, "chunk": chunk, "owner": o, "n": j - i, "k": k, "a": a, "b": b, "flags": tools.pack_bits(counts[i:j] > 1)}

        yield from tools.batches(rows(), _SENT)

    return run


def _repeated(lists: list[tuple[np.ndarray, np.ndarray]], once: list[np.ndarray]) -> np.ndarray:
    """For the entries of all lists: whether the pair occurs in another list, or twice in its own."""
    _, _, inverse, counts = _distinct(*(np.concatenate(half) for half in zip(*lists)))
    here = np.zeros(len(counts), bool)
    here[inverse[np.concatenate(once)]] = True
    return ((counts > 1) | here)[inverse]


def _answer(decode):
    def run(got: pa.Table) -> pa.Table:
        rows = got.to_pylist()
        if rows[0]["owner"] >= 0:
            flags = _repeated([decode(r) for r in rows], [tools.unpack_bits(r["flags"], r["n"]) for r in rows])
            at = 0
            for r in rows:
                r["flags"], r["a"], r["b"] = tools.pack_bits(flags[at : at + r["n"]]), b"", b""
                at += r["n"]
        return pa.Table.from_pylist(rows, _SENT)

    return run


def _cells_of(r: dict) -> tuple[np.ndarray, np.ndarray]:
    cells = tools.rice_unpack(r["n"], r["k"], r["a"], r["b"])
    return cells, np.zeros(len(cells), np.uint64)


def _pairs_of(r: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(r["a"], "<u8"), np.frombuffer(r["b"], "<u8")


def _flags(folder: str, src: int) -> dict[int, tuple[np.ndarray, tuple]]:
    """Of one source: chunk -> (flags of all its entries in order, checksum)."""
    found: dict[int, dict[int, np.ndarray]] = {}
    checks = {}
    for r in tools.published(folder, src):
        if r["owner"] < 0:
            checks[r["chunk"]] = (r["n"], r["a"])
        else:
            found.setdefault(r["chunk"], {})[r["owner"]] = tools.unpack_bits(r["flags"], r["n"])
    return {c: (np.concatenate([v for _, v in sorted(found.get(c, {}).items())] or [np.zeros(0, bool)]), check) for c, check in checks.items()}


def _let_through(keys: np.ndarray, bits: int, chunk: int, flags: dict) -> np.ndarray:
    """Which windows of a chunk have a merged count of two or more."""
    check = _check(0, chunk, keys)
    own, seen = flags.get(chunk, (None, None))
    if seen != (check["n"], check["a"]):
        raise RuntimeError("the table was read in another order than before; write it out first")
    _, inverse = np.unique(_cells(keys, bits), return_inverse=True)
    return own[inverse]


def _distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs, the place of each input pair among them, and their counts."""
    order = np.argsort(high, kind="stable")
    h = high[order]
    same = h[1:] == h[:-1]
    if (low[order][1:][same] != low[order][:-1][same]).any():  # equal halves of different windows
        order = np.lexsort((low, high))
    h, l = high[order], low[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return h[new], l[new], inverse, np.diff(np.append(np.flatnonzero(new), len(h)))


def _send_pairs(size: int, bits: int, owners: int, cells: str, limit: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            src, numbers = tools.source(), _Numbers()
            starts, flags = _starts(64, owners), _flags(cells, src)
            for chunk, _, words in _chunks(it, limit):
                high, low = _window_keys(words, size, numbers)
                keep = _let_through(high, bits, chunk, flags)
                yield _check(src, chunk, high)
                h, l, _, counts = _distinct(high[keep], low[keep])
                cuts = [*np.searchsorted(h, starts).tolist(), len(h)]
                for o, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    if i < j:
                        yield {"src": src, "chunk": chunk, "owner": o, "n": j - i, "k": 0, "a": h[i:j].astype("<u8").tobytes(), "b": l[i:j].astype("<u8").tobytes(), "flags": tools.pack_bits(counts[i:j] > 1)}

        yield from tools.batches(rows(), _SENT)

    return run


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of n words a window that begins at one of ``starts`` covers."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + size, -1)
    return np.cumsum(steps)[:n] > 0


def _cut(size: int, bits: int, cells: str, pairs: str, limit: int, with_text: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, numbers = tools.source(), _Numbers()
        through, repeated = _flags(cells, src), _flags(pairs, src)
        for chunk, held, words in _chunks(it, limit):
            high, low = _window_keys(words, size, numbers)
            keep = _let_through(high, bits, chunk, through)
            _, _, inverse, _ = _distinct(high[keep], low[keep])
            hit = np.zeros(len(high), bool)
            hit[keep] = repeated[chunk][0][inverse]
            at, out = 0, []
            for (batch, i), ws in zip(held, words):
                n = max(0, len(ws) - size + 1)
                gone = covered(np.flatnonzero(hit[at : at + n]), len(ws), size)
                at += n
                kept = b" ".join(compress(ws, (~gone).tolist()))
                out.append({"id": batch.column("id")[i].as_py(), "n_words": len(ws), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()} | ({"kept": kept.decode()} if with_text else {}))
            for i in range(0, len(out), 1000):
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out[i : i + 1000]).astype({"id": "Int64"}), preserve_index=False)

    return run


def remove_repeats(
    docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, chunk: int = CHUNK
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256; with ``with_text`` also ``kept``, the text that is left.

    Words are runs of anything but ASCII white space, unchanged.  A word goes if a window over it has the same words as a
    window that starts anywhere else, in the same text too; all windows are judged on the input.  A null or empty text
    has no words; a text shorter than a window keeps all.  Rows that repeat a text repeat its windows.  Ids may be null
    or repeat and must be integers; other columns are ignored.  ``docs`` is scanned three times and must be a table.
    """
    spark = docs.sparkSession
    tools.pin_layout(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    body = rows.select("body")
    total = body.agg(F.sum(F.octet_length("body"))).head()[0] or 0
    bits = max(16, (CELLS_PER_BYTE * total).bit_length())
    owners = tools.owners_for(spark, total, PER_OWNER)
    cells = tools.publish(tools.ask_owners(body.mapInArrow(_send_cells(size, bits, owners, chunk), _DDL), _answer(_cells_of), _DDL), "cells")
    pairs = tools.publish(tools.ask_owners(body.mapInArrow(_send_pairs(size, bits, owners, cells, chunk), _DDL), _answer(_pairs_of), _DDL), "windows")
    ddl = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return rows.mapInArrow(_cut(size, bits, cells, pairs, chunk, with_text), ddl).withColumnRenamed("id", id_col)
