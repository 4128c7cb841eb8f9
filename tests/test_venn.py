"""Covered bases of label combinations: tiles of 64 positions against sets of positions."""

import random
from collections import Counter

from strandframe.operators import sets

SCHEMA = "k string, s long, e long, src string"


def by_position(rows, labels):
    on = {}
    for k, s, e, x in rows:
        if k is not None and s is not None and x in labels:
            for p in range(s, e + 1):
                on[k, p] = on.get((k, p), 0) | 1 << labels.index(x)
    return Counter((k, m) for (k, _), m in on.items())


def test_against_positions(spark):
    """Starts and ends at all places of a tile, intervals over many tiles and over blocks, copies, negative positions, missing keys and labels."""
    rng = random.Random(3)
    rows = [(rng.choice("uv"), s := rng.randint(-900, 900), s + rng.choice([-1, 0, 1, 9, 63, 64, 127, 128, 200]), rng.choice("abcz")) for _ in range(60)]
    rows += [("w", s, s + n, "abc"[(s + n) % 3]) for s in (0, 1, 62, 63, 64, 65, 127, 128) for n in (0, 1, 62, 63, 64, 65, 128, 129)]
    rows += [("x", 5, 2_200_000, "a"), ("x", 1_048_500, 1_048_700, "b"), ("x", 1_048_576, 2_100_000, "c"), ("x", 2_199_990, 2_200_010, "b"), ("x", 5, 5, "b")]
    rows += [(None, 1, 9, "a"), ("y", 1, 9, None), ("y", None, 9, "a"), ("y", 7, 9, "b")] + rows[:20]
    got = sets.venn_bases(spark.createDataFrame(rows, SCHEMA), ["k"], "src", list("abc")).collect()
    assert {(r.k, r["mask"]): r.bases for r in got} == by_position(rows, list("abc")) and len(got) == len({(r.k, r["mask"]) for r in got})


def test_a_row_for_each_tile(spark, monkeypatch):
    """A task used to hold a row for each border of the merged intervals, in two scans."""
    seen, keep = [], sets.stored
    monkeypatch.setattr(sets, "stored", lambda df: seen.append(keep(df)) or seen[-1])
    rows = [("u", 4 * i, 4 * i + 1, "abc"[i % 3]) for i in range(1600)]
    got = sets.venn_bases(spark.createDataFrame(rows, SCHEMA), ["k"], "src", list("abc"))
    assert [x.count() for x in seen] == [100]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [lead") == 1
    assert {r["mask"]: r.bases for r in got.collect()} == {1: 1068, 2: 1066, 4: 1066}


def test_many_labels(spark):
    labels = list("abcdefgh")
    rows = [("u", 10 * i, 10 * i + 14, x) for i, x in enumerate(labels)]
    got = sets.venn_bases(spark.createDataFrame(rows, SCHEMA), ["k"], "src", labels).collect()
    assert {(r.k, r["mask"]): r.bases for r in got} == by_position(rows, labels)
