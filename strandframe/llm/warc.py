"""WARC archives as a Python data source.

Writing: each task writes gzip-compressed archives (one member for each record) below the target folder, with the record
offsets beside each file.  Only files named in a commit message enter the folder's manifest, so what a lost or repeated
task left behind is never read.

Reading: partitions are byte ranges of files, planned from sizes alone; a task takes the records that begin in its range.
Filters on record type and headers are pushed down.  The headers of a record are inflated first; the rest is read only if
the record is wanted and the asked columns need the payload.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith,
    WriterCommitMessage,
)

from .tools import open_folder, shared_folder

#: Bytes after which a task starts the next file, and bytes of a file that one partition reads.
FILE_BYTES, SPLIT_BYTES = 256 << 20, 32 << 20
#: Bytes of a record read to find its headers; doubled until they end.
HEAD_BYTES = 2048
BATCH_BYTES = 8 << 20
# Columns and the headers they stand for.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length", "content_length": "Content-Length",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(row: dict) -> bytes:
    """One record as it stands in an archive, before compression."""
    body = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    block = http + (body if row["record_type"] != "revisit" else b"")
    head = [(name, row.get(column)) for column, name in HEADERS.items() if column != "content_length"]
    if row["record_type"] == "revisit":
        head.append(("WARC-Profile", REVISIT_PROFILE))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = open_folder(self.folder)
        fs.create_dir(path, recursive=True)
        files, out, at, offsets = [], None, 0, []

        def close():
            out.close()
            with fs.open_output_stream(f"{path}/{files[-1]}.idx") as index:
                index.write(np.array(offsets, "<i8").tobytes())

        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, at, offsets = fs.open_output_stream(f"{path}/{files[-1]}", compression=None), 0, []
                pack = zlib.compressobj(3, wbits=31)
                data = pack.compress(record(row)) + pack.flush()
                offsets.append(at)
                at += len(data)
                out.write(data)
        if out is not None:
            close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, path = open_folder(self.folder)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/manifest-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages) -> None:
        fs, path = open_folder(self.folder)
        for name in [f for m in messages if m for f in m.files]:
            for file in (f"{path}/{name}", f"{path}/{name}.idx"):
                if fs.get_file_info(file).is_file:
                    fs.delete_file(file)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    indexed: bool


def holds(f: Filter, value: str | None) -> bool:
    """A pushed-down filter on a header's value."""
    if isinstance(f, IsNull):
        return value is None
    if value is None:
        return False
    return {
        EqualTo: lambda: value == f.value, In: lambda: value in f.value, IsNotNull: lambda: True, StringStartsWith: lambda: value.startswith(f.value),
        StringEndsWith: lambda: value.endswith(f.value), StringContains: lambda: f.value in value,
    }[type(f)]()


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, columns: list[str], split: int):
        self.folder, self.columns, self.split, self.filters = folder, columns, split, []

    def pushFilters(self, filters):
        for f in filters:
            if len(f.attribute) == 1 and f.attribute[0] in HEADERS and type(f) in (EqualTo, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        from pyarrow.fs import FileSelector

        fs, path = open_folder(self.folder)
        listed = {i.base_name: i.size for i in fs.get_file_info(FileSelector(path, allow_not_found=True)) if i.is_file}
        manifests = [n for n in listed if n.startswith("manifest-")]
        names = [n for n in listed if re.search(r"\.warc(\.gz)?$", n)]
        if manifests:
            names = [n for m in manifests for n in json.loads(fs.open_input_stream(f"{path}/{m}", compression=None).read())]
        out = []
        for n in sorted(names):
            indexed = f"{n}.idx" in listed
            step = self.split if indexed else max(1, listed[n])
            out += [Range(n, at, min(at + step, listed[n]), indexed) for at in range(0, listed[n], step)]
        return out

    def _records(self, p: Range):
        """(read(n) -> the first n bytes of the record, inflated as needed) for each record of a range."""
        fs, path = open_folder(self.folder)
        with fs.open_input_file(f"{path}/{p.file}") as file:
            if p.indexed:
                with fs.open_input_file(f"{path}/{p.file}.idx") as index:
                    starts = np.append(np.frombuffer(index.read(), "<i8"), file.size())
                for i in range(*np.searchsorted(starts[:-1], [p.start, p.end])):
                    yield _Member(file, int(starts[i]), int(starts[i + 1]))
            else:
                at, size = 0, file.size()
                while at < size:
                    one = (_Member if p.file.endswith(".gz") else _Plain)(file, at, size)
                    while one is not None:
                        yield one
                        last, one = one, one.rest()
                    at = last.over()

    def read(self, partition: Range | None):
        if partition is None:  # an empty folder
            return
        types = {c: pa.binary() if c == "payload" else pa.string() for c in self.columns}
        schema = pa.schema([pa.field(c, t) for c, t in types.items()])
        rows, size = [], 0
        for r in self._records(partition):
            head = r.head()
            if head is None:
                continue
            values = {c: head.get(HEADERS[c].lower()) for c in self.columns if c != "payload"}
            wanted = all(holds(f, head.get(HEADERS[f.attribute[0]].lower())) for f in self.filters)
            if wanted:
                if "payload" in self.columns:
                    values["payload"] = r.payload(head)
                    size += len(values["payload"])
                rows.append(values)
                size += 400
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class _Plain:
    """A record of an archive that is not compressed."""

    def __init__(self, file, start: int, end: int):
        self.file, self.start, self.end, self.body = file, start, end, 0

    def first(self, n: int) -> bytes:
        return self.file.read_at(min(n, self.end - self.start), self.start)

    def head(self) -> dict[str, str] | None:
        n = HEAD_BYTES
        while True:
            data = self.first(n)
            at = data.find(b"\r\n\r\n")
            if at >= 0:
                self.body = at + 4
                out = parse_head(data[:at])
                self.length = int(out.get("content-length", 0))
                return out
            if len(data) < n:
                self.length, self.body = 0, max(len(data), 1)
                return None
            n *= 2

    def payload(self, head: dict[str, str]) -> bytes:
        block = self.first(self.body + self.length)[self.body :]
        if "application/http" in head.get("content-type", ""):
            return block.partition(b"\r\n\r\n")[2]
        return block

    def rest(self) -> None:
        """The next record of the same member: only compressed ones hold several."""

    def over(self) -> int:
        return self.start + self.body + self.length + 4


class _Member(_Plain):
    """A record in a gzip member: mostly one of its own, but an archive may also be one member as a whole."""

    def __init__(self, file, start: int, end: int):
        super().__init__(file, start, end)
        self.unpack, self.data, self.at = zlib.decompressobj(wbits=31), b"", start

    def first(self, n: int) -> bytes:
        while len(self.data) < n and not self.unpack.eof:
            got = self.unpack.unconsumed_tail or self._more()
            if not got:
                break
            self.data += self.unpack.decompress(got, max(n - len(self.data), 1))
        return self.data[:n]

    def _more(self) -> bytes:
        got = self.file.read_at(min(max(HEAD_BYTES, len(self.data)), self.end - self.at), self.at)
        self.at += len(got)
        return got

    def rest(self) -> "_Member | None":
        skip = self.body + self.length + 4
        while skip or not self.data:
            if not self.data and not self.first(1 << 20 if skip else 1):
                return None
            cut = min(skip, len(self.data))
            self.data, skip = self.data[cut:], skip - cut
        out = _Member(self.file, self.start, self.end)
        out.unpack, out.data, out.at = self.unpack, self.data, self.at
        return out

    def over(self) -> int:
        while not self.unpack.eof:
            self.data = b""
            if not self.first(1 << 20):
                return self.end
        return self.at - len(self.unpack.unused_data)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], schema.names, int(self.options.get("split", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html", revisit_from: int = 100,
                  date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages``: payload the body in UTF-8 (null: empty).

    Of rows with equal payloads of at least ``revisit_from`` bytes, those with the smallest id are responses and the
    others revisits without payload; smaller payloads are all responses.  A null id is larger than any other, and a
    group of null ids only has no revisits.  A missing address becomes ``urn:record:<id>``.  Other columns are ignored.
    Payloads are compared by SHA-256; the smallest id of a group is aggregated within each task first.
    """
    register(pages.sparkSession)
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), body.alias("payload"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size"))
    firsts = rows.where(F.col("size") >= revisit_from).groupBy("digest").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "low")
    marked = rows.join(firsts, "digest", "left").withColumn("again", F.col("low").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("low"))))
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    bare = lambda c: F.regexp_replace(c, r"[\x00-\x20<>\x7F]", "_")
    marked.select(
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), urn(F.col("id")).alias("record_id"), F.lit(date).alias("date"),
        F.coalesce(bare(F.col("uri")), F.expr("concat('urn:record:', coalesce(string(id), ''))")).alias("target_uri"),
        F.when(F.col("again"), urn(F.col("low"))).alias("refers_to"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.col("size").cast("string").alias("payload_length"), F.when(~F.col("again"), F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(folder)


def read_archive(spark: SparkSession, folder: str, columns: list[str] | None = None, split: int = SPLIT_BYTES) -> DataFrame:
    """The records of a folder of archives; without ``payload`` among the columns no payload is inflated."""
    register(spark)
    columns = columns or [*HEADERS, "payload"]
    schema = ", ".join(f"{c} {'binary' if c == 'payload' else 'string'}" for c in columns)
    return spark.read.format("warc").schema(schema).option("split", split).load(folder)


def archived(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write ``pages`` to a new shared folder and read them back: id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are taken from the payload that was read, those of a revisit from its headers.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_archive(pages, folder, id_col, uri_col, body_col)
    of = lambda c: F.expr(f"cast(nullif(regexp_extract({c}, 'urn:record:([^>]*)>', 1), '') AS bigint)")
    full = read_archive(spark, folder, ["record_id", "record_type", "payload"]).where("record_type = 'response'")
    full = full.select(of("record_id").alias(id_col), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
                       "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read_archive(spark, folder, ["record_id", "record_type", "refers_to", "payload_digest", "payload_length"]).where("record_type = 'revisit'")
    again = again.select(of("record_id").alias(id_col), F.col("payload_length").cast("long").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
                         "record_type", of("refers_to").alias("refers_to"))
    return full.unionByName(again)
