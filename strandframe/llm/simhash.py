"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints are compared as classes of equal ones.  If two 64-bit fingerprints differ in at most ``tau`` bits and the bits
are dealt to m parts with thresholds t_i that sum to ``tau - m + 1`` (-1: the part is not used), some part differs in at most
t_i bits.  So:

1. Bits that go together are grouped into parts (from the 64 x 64 table of joint counts over all fingerprints).
2. For two and three parts, the thresholds of least cost are found by dynamic programming.  The cost of (part, t) is the
   number of probes plus the estimated candidates: the exact pairs of equal part values, carried on to one and two
   differing bits by the bits' own agreement.
3. Parts are indexed, every fingerprint probes all values within t_i bits, candidates are verified.
4. Index entries that more than ``CROWD`` fingerprints share are not paired.  Their members and all who probe them meet
   instead on the 65 points that differ from them in at most one bit: two fingerprints share such a point exactly if they
   differ in two bits or fewer.  At most 65 fingerprints can share one, so rows stay linear and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..session import stored
from .textcols import rows_at

BITS = 64
#: Differing bits that still link.  Step 4 holds for two.
TAU = 2
#: Largest index entry that is paired directly; above it the 65 points are fewer rows.
CROWD = 64
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of one text, A-Z lower-cased; as a signed 64-bit number, 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        a, b = starts[at : min(n, at + BLOCK)].tolist(), ends[at + size - 1 : min(n, at + BLOCK) + size - 1].tolist()
        h = np.array([xxhash.xxh64_intdigest(body[i:j], seed) for i, j in zip(a, b)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in it:
        yield pd.Series([fingerprint((x or "").encode()) for x in s], dtype="int64")


def _joint(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task: how many fingerprints have both bits set, for each pair of bits."""
    total = np.zeros((BITS, BITS), np.int64)
    for batch in it:
        values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(values), BLOCK):
            x = np.unpackbits(values[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (x.T @ x).astype(np.int64)
    i, j = np.indices(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "n"])


def _bit_table(fps: DataFrame) -> np.ndarray:
    """64 x 64 joint counts; that many rows reach the driver at any input size."""
    out = np.zeros((BITS, BITS))
    for r in fps.select("fp").mapInArrow(_joint, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r.i, r.j] = r.n
    return out


def correlated_parts(joint: np.ndarray, total: int, m: int) -> list[list[int]]:
    """Bits in m parts of equal width: each part starts with a free bit and takes those that correlate most with it."""
    p = np.diag(joint) / max(total, 1)
    cov = joint / max(total, 1) - np.outer(p, p)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    corr = np.abs(cov / spread)
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for i in range(m):
        width = -(-len(free) // (m - i))
        part = [max(free, key=lambda b: corr[b, free].sum())]
        free.remove(part[0])
        while len(part) < width:
            best = max(free, key=lambda b: corr[b, part].sum())
            part.append(best)
            free.remove(best)
        out.append(sorted(part))
    return out


def allot(costs: list[dict[int, float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds, one for each part, that sum to ``budget`` at the least total cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for of_part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t, c in of_part.items():
                if used + t not in step or cost + c < step[used + t][0]:
                    step[used + t] = (cost + c, [*ts, t])
        best = step
    return best[budget]


def _mask(bits: tuple[int, ...] | list[int]) -> int:
    """As a signed number."""
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _plan(fps: DataFrame) -> list[tuple[list[int], int]]:
    """The used (part, threshold) of the cheapest dealing into two or three parts."""
    joint, total = _bit_table(fps), fps.count()
    ways = {m: correlated_parts(joint, total, m) for m in (2, 3)}
    values = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(part))).alias("v")) for m, ps in ways.items() for i, part in enumerate(ps)]
    counted = fps.select(F.explode(F.array(*values)).alias("x")).groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("n"))
    equal = {(r.m, r.i): r.pairs for r in counted.groupBy("x.m", "x.i").agg(F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).collect()}
    p = np.diag(joint) / max(total, 1)
    agree = p**2 + (1 - p) ** 2
    found = []
    for m, ps in ways.items():
        costs = []
        for i, part in enumerate(ps):
            grow = float(((1 - agree[part]) / agree[part]).sum())
            wider = [1, 1 + grow, 1 + grow + grow**2 / 2]
            of = {t: total * sum(comb(len(part), j) for j in range(t + 1)) + (equal.get((m, i)) or 0) * wider[t] for t in range(TAU + 1)}
            costs.append({-1: 0.0} | of)
        found.append((*allot(costs, TAU - m + 1), ps))
    _, ts, ps = min(found, key=lambda x: x[0])
    return [(part, t) for part, t in zip(ps, ts) if t >= 0]


def _entries(fps: DataFrame, plan: list[tuple[list[int], int]], probe: bool) -> DataFrame:
    """(part, v, fp): the index, or every probe within the part's threshold."""
    rows = []
    for i, (part, t) in enumerate(plan):
        flips = [_mask(c) for j in range((t if probe else 0) + 1) for c in combinations(part, j)]
        own = F.col("fp").bitwiseAND(F.lit(_mask(part)))
        rows += [F.struct(F.lit(i).alias("part"), own.bitwiseXOR(F.lit(f)).alias("v")) for f in flips]
    return fps.select("fp", F.explode(F.array(*rows)).alias("e")).select("e.part", "e.v", "fp")


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= TAU


def links(fps: DataFrame) -> DataFrame:
    """(a, b) over distinct fingerprints ``fp``; same components as all pairs of at most two differing bits."""
    plan = _plan(fps)
    index, probes = _entries(fps, plan, False), _entries(fps, plan, True)
    crowded = index.groupBy("part", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("part", "v")
    sparse = index.join(crowded, ["part", "v"], "left_anti").withColumnRenamed("fp", "b")
    pairs = probes.withColumnRenamed("fp", "a").join(sparse, ["part", "v"]).where((F.col("a") < F.col("b")) & _near("a", "b")).select("a", "b")
    busy = probes.join(crowded, ["part", "v"], "left_semi").select("fp").distinct()
    points = F.array("fp", *[F.col("fp").bitwiseXOR(F.lit(_mask((b,)))) for b in range(BITS)])
    met = busy.select("fp", F.explode(points).alias("point")).groupBy("point").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))
    return pairs.union(met.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a != b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    A null text counts as empty and has fingerprint 0, linked like any other.  Null ids get the component of their text
    and never name it; a component of null ids only has a null component_id.  Other columns are ignored.
    """
    rows = stored(docs.select(F.col(id_col).alias("id"), _fingerprints(F.coalesce(F.col(text_col), F.lit(""))).alias("fp")))
    classes = _classes(stored(rows.groupBy("fp").agg(F.min("id").alias("first"))))
    lowest = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = classes.join(lowest, "component").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(fps: DataFrame) -> DataFrame:
    """``fps`` with the component of each fingerprint."""
    found = connected_components(links(fps), "a", "b").select(F.col("node").alias("fp"), "component")
    return fps.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component one row of ``docs``, all columns: that with the smallest id, of equal ids the smallest text hash.

    A null id stays only in a component without any other.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(F.col(id_col).alias("id"), F.sha2(body, 256).alias("sha"), _fingerprints(body).alias("fp")))
    own = F.struct(F.col("id").isNull().alias("none"), "id", "sha")
    classes = _classes(stored(rows.groupBy("fp").agg(F.min(own).alias("first"))))
    kept = classes.groupBy("component").agg(F.min("first").alias("first")).select("first.id", "first.sha")
    times = rows.groupBy("id", "sha").agg((F.count(F.lit(1)) > 1).alias("repeated")).withColumnsRenamed({"id": "_id", "sha": "_sha"})
    kept = kept.join(times, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))).select("id", "sha", "repeated")
    return rows_at(docs, stored(kept), id_col, text_col)
