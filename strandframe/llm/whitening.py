"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

1. Vectors become rows of long integers, packed into blocks and stored once; their sums are exact.
2. Let X be the centred rows.  Step j multiplies X by a direction, which gives a number for each row (the left vector u_j,
   spread over the table), and Xᵀ by these numbers, which gives the next direction v_j+1.  The driver holds directions only,
   never anything that has an entry for each row.
3. Both sides are fully reorthogonalised, twice.  A left vector is kept as the direction p_j with u_j = X p_j, so the
   products of a new left vector with all earlier ones are pᵀ(Xᵀ X q): one pass over the blocks serves both products of a
   step, and a lost task is computed again from the blocks alone.
4. The small bidiagonal matrix has the singular values of X; its right singular vectors turn the directions into
   components.  One more pass measures the covariance of the whitened rows.

A direction that is used up (the rows have a lower rank, or an eigenvalue repeats) is replaced by a fixed pseudo-random one
orthogonal to all earlier ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Rows of a block.
BLOCK = 4096
#: Partial sums that the driver takes at once; of more, tasks add up about as many as their square root first.
DIRECT = 256
#: Relative to the largest coefficient: what is smaller is rounding.
TINY = 1e-11
#: So many directions are always built (or all there are); beyond that, the wanted components may converge before.
LEAST = 64
#: Integers up to here are kept; larger ones are cut to it, as a cast to long would.
_LIMIT = float(1 << 62)
_FITS = float(1 << 62)


@dataclass(frozen=True)
class Fit:
    """Whitening of ``dims`` dimensions: n rows with sums ``total``, components as columns, their variances, and their share of the trace."""

    dims: int
    n: int
    total: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    steps: int


def usable(vectors: DataFrame, vec_col: str) -> tuple[DataFrame, int]:
    """Rows whose vector is complete and finite, as doubles in ``vec_col``; and the commonest length among them (of ties the longest)."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    rows = vectors.where(vec.isNotNull() & (F.size(vec) > 0) & finite).withColumn(vec_col, vec)
    lengths = rows.groupBy(F.size(vec_col).alias("d")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    return rows, int(first.d) if first else 0


def quantised(c: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 as long."""
    return np.clip(np.floor(1024 * c), -_LIMIT, _LIMIT).astype(np.int64) + 100000


def _pack(dims: int, schema: pa.Schema) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            chunk = pa.concat_arrays(ids)
            names = pa.ListArray.from_arrays(pa.array([0, len(chunk)], pa.int32()), chunk)
            out = pa.RecordBatch.from_arrays([names, pa.array([np.concatenate(held).tobytes()], pa.binary())], schema=schema)
            ids.clear()
            held.clear()
            return out

        for batch in it:
            values = batch.column(1)
            rows = quantised(np.asarray(values.flatten(), np.float64).reshape(-1, dims))
            for at in range(0, len(rows), BLOCK):
                ids.append(batch.column(0).slice(at, BLOCK))
                held.append(rows[at : at + BLOCK])
                if sum(map(len, held)) >= BLOCK:
                    yield block()
        if held:
            yield block()

    return run


def packed(rows: DataFrame, dims: int, id_col: str, vec_col: str) -> DataFrame:
    """Stored blocks: ids and, row by row, the integers of their vectors."""
    from pyspark.sql.pandas.types import to_arrow_type

    narrow = rows.where(F.size(vec_col) == dims).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    kind = narrow.schema["id"].dataType
    schema = pa.schema([("ids", pa.list_(to_arrow_type(kind))), ("x", pa.binary())])
    return stored(narrow.mapInArrow(_pack(dims, schema), f"ids array<{kind.simpleString()}>, x binary"))


def _ints(value: pa.Scalar, dims: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int64).reshape(-1, dims)


def _differences(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n x - total, exact; of Python integers only where 64 bits may not do."""
    if len(x) and float(n) * max(abs(float(x.min())), abs(float(x.max()))) + float(np.abs(total).max()) > _FITS:
        return x.astype(object) * n - total
    return x * np.int64(n) - total.astype(np.int64)


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    return (_differences(x, n, total) / n).astype(np.float64)


def _added(blocks: DataFrame, dims: int, per_block: Callable[[np.ndarray], np.ndarray], dtype=np.float64) -> np.ndarray:
    """The sum of ``per_block(integers)`` over all blocks.

    Every task adds up its blocks.  Its one short row goes to the driver, or, where there are over ``DIRECT`` tasks, first
    to one of about the square root of their number.  Sums are added in the order of the tasks.
    """

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in it:
            for value in batch.column(0):
                got = per_block(_ints(value, dims))
                out = got if out is None else out + got
        if out is not None:
            yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "part": [out.astype(dtype).tobytes()]})

    def several(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((t, p) for batch in it for t, p in zip(*(c.to_pylist() for c in batch.columns)))
        if got:
            out = sum(np.frombuffer(p, dtype) for _, p in got)
            yield pa.RecordBatch.from_pydict({"task": [got[0][0]], "part": [out.tobytes()]})

    ddl = "task long, part binary"
    sums = blocks.select("x").mapInArrow(each, ddl)
    tasks = blocks.rdd.getNumPartitions()
    if tasks > DIRECT:
        sums = sums.repartition(math.isqrt(tasks)).mapInArrow(several, ddl)
    rows = sorted((r.task, bytes(r.part)) for r in sums.collect())
    return sum((np.frombuffer(p, dtype) for _, p in rows[1:]), start=np.frombuffer(rows[0][1], dtype).copy()) if rows else np.zeros(0, dtype)


def _totals(blocks: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Number of rows, and exact sums as Python integers: high and low halves are added apart."""
    got = _added(blocks, dims, lambda x: np.concatenate([[len(x)], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]), np.int64)
    if not len(got):
        return 0, np.zeros(dims, object)
    return int(got[0]), np.array([(int(h) << 32) + int(low) for h, low in zip(got[1 : dims + 1], got[dims + 1 :])], object)


def _orthogonal(rng: np.random.Generator, basis: np.ndarray) -> np.ndarray:
    v = rng.standard_normal(len(basis))
    for _ in range(2):
        v -= basis @ (basis.T @ v)
        v /= np.linalg.norm(v)
    return v


def bidiagonalised(product: Callable[[np.ndarray], tuple[np.ndarray, float]], dims: int, wanted: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Singular values of X, falling, and its right singular vectors as columns; steps taken.

    ``product(q)`` is (Xᵀ X q, |X q|²), one pass over the rows.
    """
    rng = np.random.default_rng(11)
    none = np.zeros((dims, 0))
    right, left, images = none, none, none  # v_j, p_j and Xᵀ X p_j as columns
    diagonal: list[float] = []
    upper: list[float] = []
    scale = 0.0
    v = _orthogonal(rng, none)
    for step in range(1, dims + 1):
        right = np.column_stack([right, v])
        q = v - upper[-1] * left[:, -1] if upper else v.copy()
        image, norm2 = product(q)
        for _ in range(2):
            along = left.T @ image
            q, image, norm2 = q - left @ along, image - images @ along, norm2 - along @ along
        a = math.sqrt(max(norm2, 0.0))
        scale = max(scale, a)
        ended = a <= TINY * scale
        a = 0.0 if ended else a
        p, z = (np.zeros(dims), np.zeros(dims)) if ended else (q / a, image / a)
        left, images = np.column_stack([left, p]), np.column_stack([images, z])
        diagonal.append(a)
        r = z - a * v
        for _ in range(2):
            r = r - right @ (right.T @ r)
        b = float(np.linalg.norm(r))
        b = 0.0 if b <= TINY * scale else b
        scale = max(scale, b)
        small = np.diag(diagonal) + np.diag(upper, 1)
        if step == dims or step >= LEAST:
            u, sigma, vt = np.linalg.svd(small)
            if step == dims or (step > wanted and b * np.abs(u[-1, :wanted]).max() <= 1e-14 * sigma[0]):
                return sigma, right @ vt.T, step
        upper.append(b)
        v = r / b if b else _orthogonal(rng, right)
    raise AssertionError


def fit(blocks: DataFrame, dims: int, wanted: int) -> Fit:
    """Components of the covariance of all rows of ``blocks`` (divisor n), numbered by falling variance, at most ``wanted``."""
    n, total = _totals(blocks, dims)
    if not n:
        return Fit(dims, 0, total, np.zeros((dims, 0)), np.zeros(0), np.zeros(0), 0)

    def product(q: np.ndarray) -> tuple[np.ndarray, float]:
        def of(x: np.ndarray) -> np.ndarray:
            rows = centred(x, n, total)
            u = rows @ q
            return np.append(rows.T @ u, u @ u)

        got = _added(blocks, dims, of)
        return got[:-1], float(got[-1])

    trace = float(_added(blocks, dims, lambda x: np.array([np.square(centred(x, n, total)).sum()]))[0]) / n
    sigma, vectors, steps = bidiagonalised(product, dims, wanted)
    k = int((sigma[:wanted] > TINY * max(sigma[0], 1e-300)).sum())
    variances = sigma[:k] ** 2 / n
    return Fit(dims, n, total, vectors[:, :k], variances, variances / trace if k else variances, steps)


def _directions(f: Fit) -> np.ndarray:
    return f.components / np.sqrt(f.variances)


def identity_error(blocks: DataFrame, f: Fit) -> float:
    """The largest entry, without sign, of the covariance of the whitened rows minus the identity."""
    k, by = len(f.variances), _directions(f)

    def of(x: np.ndarray) -> np.ndarray:
        y = centred(x, f.n, f.total) @ by
        return np.concatenate([y.sum(0), (y.T @ y).ravel()])

    got = _added(blocks, f.dims, of) / f.n
    return float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())


def _squares(d: np.ndarray) -> list[int | None]:
    """Sums of squares of integer rows; None where 64 bits don't hold one."""
    about = np.square(d.astype(np.float64)).sum(1)
    if not len(d) or about.max() < _FITS:
        return np.square(d.astype(np.int64)).sum(1).tolist()
    exact = [sum(int(v) * int(v) for v in row) for row in d]
    return [e if e < 1 << 63 else None for e in exact]


def _whiten(f: Fit, error: float, schema: pa.Schema) -> Callable:
    k, by = len(f.variances), _directions(f)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for ids, value in zip(batch.column(0), batch.column(1)):
                d = _differences(_ints(value, f.dims), f.n, f.total)
                y = (d / f.n).astype(np.float64) @ by
                m = len(y)
                yield pa.RecordBatch.from_arrays([
                    ids.values.take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n)),
                    pa.array(_squares(d), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(y.ravel()), pa.array(np.tile(f.explained, m)), pa.array(np.full(m * k, error)),
                ], schema=schema)

    return run


def whitened(vectors: DataFrame, wanted: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error.

    A vector is dropped if it is null or empty, holds a null, NaN or infinite entry, or has another length than most of them
    (of ties the longest length stays).  Null and repeated ids are kept row by row; equal vectors count as often as they
    stand.  Entries beyond 64 bits after scaling are cut to the range.  ``deviation`` is null where it takes more than 64
    bits.  Rank below ``wanted`` gives fewer components; a table without usable vectors, or with equal ones only, gives no
    row.  Other columns, whatever their names, are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = vectors.schema[id_col].dataType
    ddl = f"`{id_col}` {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, dims = usable(vectors.select(id_col, vec_col), vec_col)
    if dims:
        blocks = packed(rows, dims, id_col, vec_col)
        f = fit(blocks, dims, wanted)
        if len(f.variances):
            schema = to_arrow_schema(StructType.fromDDL(ddl))
            return blocks.mapInArrow(_whiten(f, identity_error(blocks, f), schema), ddl)
    return vectors.sparkSession.createDataFrame([], ddl)
