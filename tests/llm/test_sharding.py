"""Rendezvous shards against a plain version: every bid computed in Python."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from strandframe.llm import sharding
from strandframe.llm.queries import GROWN, QUERIES, SHARDS

SF = "/root/testdata/sf0.001"


def bid(key, shard, weight):
    drawn = int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:12], 16)
    return -math.log((drawn + 0.5) / 2.0**48) / weight


def best(key, shards):
    return min((bid(key, s, w), s) for s, w in shards.items())[1]


def test_registered_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op12_sharding"](spark, SF).collect()
    assert len(got) == len(docs)
    slots = defaultdict(list)
    for r in got:
        body = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(body) + 8, zlib.crc32(body), "key")
        assert r.shard == best(r.doc_id, SHARDS) and r.grown_shard == best(r.doc_id, SHARDS | GROWN)
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append((r.doc_id, r.slot))
    for rows in slots.values():
        assert [s for _, s in sorted(rows)] == list(range(len(rows)))


def test_weights_and_moves(spark):
    ids = spark.range(6000).selectExpr("id doc_id", "'' text")
    shards = {3: 1.0, 5: 2.0, 9: 3.0}
    got = sharding.assigned(ids, shards, {11: 2.0}).collect()
    share = Counter(r.shard for r in got)
    assert all(abs(share[s] - 1000 * w) < 130 for s, w in shards.items())
    moved = [r for r in got if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {11} and abs(len(moved) - 1500) < 150
    with pytest.raises(ValueError):
        sharding.assigned(ids, {1: 0.0}, {})


def test_odd_rows(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (1, None, "z"), (None, "b", "x"), (None, "b", "x"), (2, "", "x"), (3, "é" * 70000, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.assigned(frame, {0: 1.0, 1: 1.0}, {}).collect()
    assert len(got) == 7 and all(r.grown_shard == r.shard for r in got)
    for shard in (0, 1):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert len({r.shard for r in got if r.doc_id == 1}) == 1 and {r["size"] for r in got if r.doc_id == 3} == {140008}
    assert {r.shard for r in got if r.doc_id is None} == {best("", {0: 1.0, 1: 1.0})}
    assert sharding.assigned(frame.limit(0), {0: 1.0}, {}).count() == 0


def test_hot_key_is_numbered_by_many_tasks(spark):
    got = sharding.assigned(spark.range(4000).selectExpr("cast(null as long) doc_id", "'same' text"), {0: 1.0, 1: 1.0}, {}).collect()
    assert sorted(r.slot for r in got) == list(range(4000))


def test_written_shards(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"t{i}", {"a": i}) for i in range(50)], "doc_id long, text string, m map<string,int>")
    sharding.write_shards(frame, {0: 1.0, 1: 1.0}, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.doc_id for r in back) == list(range(50)) and all(r._shard == best(r.doc_id, {0: 1.0, 1: 1.0}) and r.m == {"a": r.doc_id} for r in back)
    with pytest.raises(ValueError):
        sharding.write_shards(frame.withColumn("_shard", sharding.F.lit(1)), {0: 1.0}, f"{tmp_path}/other")
