"""WARC archives: round trip, revisits, pushed filters, foreign files."""

import gzip
import hashlib

from strandframe.llm import warc

LONG = "é" * 60


def test_round_trip(spark, tmp_path):
    rows = [(5, "http://a/ b\r\n", LONG), (3, None, LONG), (9, "u", LONG), (None, "u", LONG), (1, "u", None), (2, "u", ""), (4, "u", "\r\n\r\nx\r\n"),
            (6, "u", "s" * 99), (7, "u", "s" * 99), (8, "u", "z" * 300000), (3, None, LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((tuple(r) for r in warc.archived(df).collect()), key=repr)
    want = []
    for i, _, t in rows:
        b = (t or "").encode()
        again = t == LONG and i != 3
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want, key=repr)
    assert warc.archived(df.limit(0)).count() == 0
    assert warc.archived(spark.createDataFrame([(None, "u", LONG)] * 2, df.schema)).where("record_type = 'response'").count() == 2


def test_splits_filters_and_columns(spark, tmp_path):
    folder = str(tmp_path / "w")
    df = spark.range(500).selectExpr("id AS page_id", "concat('http://h', id % 7, '/', id) AS url", "repeat(string(id % 400), 50) AS html")
    warc.write_archive(df.repartition(2), folder)
    back = warc.read_archive(spark, folder, split=500)
    assert back.rdd.getNumPartitions() > 10 and back.count() == 500
    assert back.where("record_type = 'revisit' AND target_uri LIKE 'http://h3/%'").count() == sum(1 for i in range(410, 500) if i % 7 == 3)
    heads = warc.read_archive(spark, folder, ["record_id", "record_type"]).where("record_type = 'response' AND record_id = '<urn:record:7>'")
    assert [tuple(r) for r in heads.collect()] == [("<urn:record:7>", "response")]


def test_pushed_and_not_read():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = warc.WarcReader("x", ["record_type", "payload"], 1)
    left = GreaterThan(("date",), "2000")
    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), left])) == [left] and len(reader.filters) == 1


def test_foreign_archives(spark, tmp_path):
    """No manifest and no index: every archive is read whole, compressed or not; other record types are kept apart by filters."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    one = warc.record({"record_type": "response", "record_id": "<a>", "payload_length": 4, "payload": b"\xff\x00zz"})
    (tmp_path / "a.warc").write_bytes(info + one)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(one * 1) + gzip.compress(one))
    (tmp_path / "note.txt").write_text("x")
    back = warc.read_archive(spark, str(tmp_path))
    assert back.count() == 5
    assert [bytes(r.payload) for r in back.where("record_type = 'response'").collect()] == [b"\xff\x00zz"] * 3
    assert [bytes(r.payload) for r in back.where("record_type = 'warcinfo'").collect()] == [b"hello"] * 2


def test_members_with_several_records(spark, tmp_path):
    """Archives compressed as a whole, or some records at a time: none is lost, however large."""
    def record(i, body):
        return (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:{i}>\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"

    bodies = [b"", b"a", bytes(range(256)) * 9000, b"WARC/1.0\r\n\r\n" * 50, b"x" * 70000, b"end"]
    records = [record(i, b) for i, b in enumerate(bodies)]
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "parts.warc.gz").write_bytes(b"".join(gzip.compress(b"".join(records[i : i + 2])) for i in (0, 2, 4)))
    (tmp_path / "single.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    for columns in (["record_id", "payload"], ["record_id"]):
        got = warc.read_archive(spark, str(tmp_path), columns).collect()
        assert sorted(r.record_id for r in got) == sorted(f"<urn:record:{i}>" for i in range(6) for _ in range(3))
        assert columns == ["record_id"] or all(bytes(r.payload) == bodies[int(r.record_id[12:-1])] for r in got)
