"""Shared small parts: tables by name, folders all machines reach, bit-packed sorted numbers, the source-owner exchange.

The exchange is the pattern behind exact dedup, substring dedup and BPE encoding.  Every partition of a table scan (a
*source*) sends what it knows, packed, to *owners* chosen by hash; owners merge and answer each source; the answers are
published below ``spark.checkpoint.dir`` and a later pass over the same scan reads only those of its own source.  No row of
the table itself is shuffled for that, and neither the driver nor any task holds more than one source or one owner.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Sources whose answers share one folder.
SOURCES_PER_SHELF = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def open_folder(uri: str):
    """(file system, path) of a shared folder, usable inside a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else uri)


def pin_layout(spark: SparkSession) -> None:
    """Let file scans be cut alike in every pass, also when executors come or go in between."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def owners_for(spark: SparkSession, entries: int, each: int) -> int:
    """How many owners: at most ``each`` entries for one on average, and enough for all tasks."""
    return max(parts(spark), -(-entries // each))


def source() -> int:
    return TaskContext.get().partitionId()


def utf8(array: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; a null is empty."""
    return [x or b"" for x in array.cast(pa.large_binary()).to_pylist()]


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def rice_pack(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Golomb code, with a power of two as divisor, of the gaps of sorted distinct numbers: (k, quotients, remainders)."""
    n = len(values)
    if not n:
        return 0, b"", b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, int(values[-1] // n).bit_length() - 1)
    high = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(high + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    low = np.empty((n, k), np.uint8)
    for j in range(k):
        low[:, j] = (gaps >> np.uint64(k - 1 - j)) & np.uint64(1)
    return k, np.packbits(unary).tobytes(), np.packbits(low.ravel()).tobytes()


def rice_unpack(n: int, k: int, unary: bytes, low: bytes) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n] + 1
    gaps = (np.diff(ends, prepend=0) - 1).astype(np.uint64)
    if k:
        bits = np.unpackbits(np.frombuffer(low, np.uint8), count=n * k).reshape(n, k)
        for j in range(k):
            gaps = (gaps << np.uint64(1)) | bits[:, j].astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def ask_owners(sent: DataFrame, answer, schema: str) -> DataFrame:
    """``answer(pa.Table) -> pa.Table`` for the rows of each owner."""
    n = max(parts(sent.sparkSession), sent.sparkSession.sparkContext.defaultParallelism)
    return sent.repartition(n, "owner").groupBy("owner").applyInArrow(answer, schema)


def publish(answers: DataFrame, name: str) -> str:
    """Write answers (with a column ``src``) so that a source finds its own; returns the folder."""
    spark = answers.sparkSession
    folder = shared_folder(spark, name)
    shelved = answers.withColumn("shelf", F.expr(f"src div {SOURCES_PER_SHELF}")).repartition(parts(spark), "src")
    shelved.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).partitionBy("shelf").parquet(folder)
    return folder


def published(folder: str, src: int) -> Iterator[dict]:
    """The answers for one source, row by row; nothing if there are none."""
    import pyarrow.dataset as ds

    fs, path = open_folder(folder)
    shelf = f"{path}/shelf={src // SOURCES_PER_SHELF}"
    if not fs.get_file_info(shelf).is_file and fs.get_file_info(shelf).type.name == "Directory":
        found = ds.dataset(shelf, format="parquet", filesystem=fs, exclude_invalid_files=False)
        for batch in found.to_batches(filter=ds.field("src") == src, batch_size=256):
            yield from batch.to_pylist()


def batches(rows: Iterator[dict], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``limit`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row.values() if isinstance(x, (bytes, str)))
        if size >= limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
