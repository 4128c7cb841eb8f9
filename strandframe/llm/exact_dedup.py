"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every source hashes its texts to ``log2(rows) + 10`` bits and sends each owner (a range of hashes) its distinct hashes,
   sorted and Golomb-coded, with a bit for those it has more than once.
2. Owners merge the lists and answer with a bitmap: which hashes occur more than once anywhere.
3. A second scan marks suspects.  A hash that is listed with bit 0 belongs to exactly one row of the whole table, which is
   therefore unique; one in about a thousand unique rows is a false suspect.  A hash that the source's own list lacks
   (the scan was cut in another way) makes a suspect too, so the result never depends on the layout.
4. Only suspects' texts are shuffled.  Their whole bytes are the grouping key, combined within each task first, so a
   group that holds a third of all rows arrives as one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import tools
from .textcols import rows_at

#: Extra fingerprint bits: one false suspect in 2^EXTRA_BITS rows.
EXTRA_BITS = 10
#: Hashes that one owner merges.
PER_OWNER = 1 << 21

_SENT = pa.schema([("src", pa.int32()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()),
                   ("quotients", pa.binary()), ("remainders", pa.binary()), ("repeated", pa.binary())])
_DDL = "src int, owner int, n int, k int, quotients binary, remainders binary, repeated binary"


def _fingerprint(text, bits: int):
    return F.shiftrightunsigned(F.xxhash64(text), 64 - bits)


def _send(bits: int, owners: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b.column(0).to_numpy(zero_copy_only=False) for b in it]
        values, counts = np.unique(np.concatenate(own or [np.zeros(0, np.int64)]).astype(np.uint64), return_counts=True)
        cuts = np.searchsorted(values, _starts(bits, owners))
        rows = ((o, values[a:b] - start, counts[a:b] > 1)
                for o, (a, b, start) in enumerate(zip(cuts, [*cuts[1:], len(values)], _starts(bits, owners))) if a < b)
        packed = ((o, v, t, tools.rice_pack(v)) for o, v, t in rows)
        yield from tools.batches(
            ({"src": tools.source(), "owner": o, "n": len(v), "k": p[0], "quotients": p[1], "remainders": p[2], "repeated": tools.pack_bits(t)}
             for o, v, t, p in packed), _SENT)

    return run


def _starts(bits: int, owners: int) -> np.ndarray:
    """The first hash of each owner."""
    return np.array([(o << bits) // owners for o in range(owners)], np.uint64)


def _merge(got: pa.Table) -> pa.Table:
    rows = got.to_pylist()
    lists = [tools.rice_unpack(r["n"], r["k"], r["quotients"], r["remainders"]) for r in rows]
    flat = np.concatenate(lists)
    once = np.concatenate([tools.unpack_bits(r["repeated"], r["n"]) for r in rows])
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    here = np.zeros(len(counts), bool)
    here[inverse[once]] = True
    repeated = ((counts > 1) | here)[inverse]
    at = 0
    for r in rows:
        r["repeated"] = tools.pack_bits(repeated[at : at + r["n"]])
        at += r["n"]
    return pa.Table.from_pylist(rows, _SENT)


def _suspect(folder: str, bits: int, owners: int):
    @F.pandas_udf("boolean")
    def marked(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        starts = _starts(bits, owners)
        lists = [(starts[r["owner"]] + tools.rice_unpack(r["n"], r["k"], r["quotients"], r["remainders"]), tools.unpack_bits(r["repeated"], r["n"]))
                 for r in tools.published(folder, tools.source())]
        known = np.concatenate([x[0] for x in lists] or [np.zeros(0, np.uint64)])
        repeated = np.concatenate([x[1] for x in lists] or [np.zeros(0, bool)])
        order = np.argsort(known)
        known, repeated = known[order], repeated[order]
        for s in it:
            h = s.to_numpy().astype(np.uint64)
            if not len(known):
                yield pd.Series(np.ones(len(h), bool))
                continue
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            yield pd.Series((known[at] != h) | repeated[at])

    return marked


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, so null and empty texts form one group.  The row with the largest id of a group stays;
    null ids come last, and a group with null ids only has a null keep_id.  Of rows that repeat both text and id, exactly
    one is ``kept``.  Other columns are ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tools.pin_layout(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    n = rows.count()
    bits = min(63, max(16, n.bit_length() + EXTRA_BITS))
    owners = tools.owners_for(spark, n, PER_OWNER)
    sent = rows.select(_fingerprint("body", bits).alias("h")).mapInArrow(_send(bits, owners), _DDL)
    folder = tools.publish(tools.ask_owners(sent, _merge, _DDL), "fingerprints")

    marked = rows.select("id", "body", F.monotonically_increasing_id().alias("row"), _fingerprint("body", bits).alias("h"))
    marked = marked.withColumn("suspect", _suspect(folder, bits, owners)("h"))
    sha = F.sha2("body", 256).alias("text_sha256")
    unique = marked.where("not suspect").select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha
    )
    suspects = marked.where("suspect")
    groups = suspects.groupBy("body").agg(F.max(F.struct("id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(sha, F.col("last.id").alias("keep_id"), F.col("last.row").alias("keep_row"), "group_size")
    members = suspects.select("id", "row", sha).join(groups, "text_sha256")
    kept = F.col("row") == F.col("keep_row")
    return unique.unionByName(members.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``kept`` rows of ``docs``, all columns: one for each text, also where ids repeat or are null."""
    kept = exact_duplicates(docs, id_col, text_col).where("kept")
    kept = stored(kept.select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"), (F.col("group_size") > 1).alias("repeated")))
    return rows_at(docs, kept, id_col, text_col)
