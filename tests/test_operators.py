"""Distributed operators against brute force, with small blocks and a crowded key."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import cohort, components, islands, lookup, ranges, scans, similarity


def intervals(rng, n, top, keys=3):
    out = []
    for i in range(n):
        s = rng.randint(0, top)
        out.append((i, rng.choice([0] * 4 + list(range(keys))), s, s + rng.choice([0, 1, 3, 9, 40])))
    return out


@pytest.mark.parametrize("gap", [-1, 0, 1])
def test_islands_across_blocks(spark, gap):
    rng = random.Random(gap)
    rows = intervals(rng, 400, 1500)
    df = spark.createDataFrame(rows, "id int, k int, s bigint, e bigint")
    want = {}
    for k in {r[1] for r in rows}:
        start = end = None
        for i, _, s, e in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[3])):
            if end is None or s > end + gap:
                start, end = s, e
            end = max(end, e)
            want[i] = (k, start)
    got = islands.assign_islands(df, ["k"], gap=gap, bits=4).collect()
    assert {r["id"]: (r["k"], r["island"]) for r in got} == want
    merged = {(r["k"], r["s"]): r["e"] for r in islands.merge_intervals(df, ["k"], gap=gap, bits=4).collect()}
    ends = {}
    for i, k, s, e in rows:
        ends[want[i]] = max(ends.get(want[i], e), e)
    assert merged == ends
    sums = islands.bundle_summary(df.select("k", F.col("s").alias("start"), F.col("e").alias("end")), ["k"], gap=gap, bits=4).collect()
    assert {(r["k"], r["bundle_start"]): r["bundle_end"] for r in sums} == ends and sum(r["n_tx"] for r in sums) == len(rows)


def test_range_joins(spark):
    rng = random.Random(2)
    a, b = intervals(rng, 150, 900), intervals(rng, 150, 900)
    b += [(500, 0, 0, 5000), (501, 1, 100, 70000)]
    schema = "id int, k int, s bigint, e bigint"
    A, B = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    lv = (3, 6, 9)
    over = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    got = ranges.overlap_join(A, B, ["k"], "s", "e", levels=lv).select("l_id", "r_id").collect()
    assert sorted(map(tuple, got)) == over
    own = sorted((x[0], y[0]) for x in a for y in a if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3] and (x[2], x[0]) < (y[2], y[0]))
    got = ranges.self_overlap(A, ["k"], "id", "s", "e", levels=lv).select("l_id", "r_id").collect()
    assert sorted(map(tuple, got)) == own
    inner = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and y[2] <= x[2] and x[3] <= y[3])
    got = ranges.contained_join(A, B, ["k"], levels=lv).select("l_id", "r_id").collect()
    assert sorted(map(tuple, got)) == inner
    flags = {r["id"]: r["is_contained"] for r in ranges.containing(A, B, ["k"]).collect()}
    assert flags == {x[0]: any(i == x[0] for i, _ in inner) for x in a}
    holds = {r["id"]: r["holds_any"] for r in ranges.holding(B, A, ["k"]).collect()}
    assert holds == {y[0]: any(j == y[0] for _, j in inner) for y in b}
    near = {r["id"]: (r["n_le"], r["n_le_id"], r["n_ge"]) for r in ranges.nearest(A, B.select("k", F.col("s").alias("p"), F.col("id").alias("b")), ["k"], "s", "p", "b", out="n").collect()}
    for x in a:
        le = [y for y in b if y[1] == x[1] and y[2] <= x[2]]
        ge = [y[2] for y in b if y[1] == x[1] and y[2] >= x[2]]
        at = max((y[2] for y in le), default=None)
        assert near[x[0]] == (at, min((y[0] for y in le if y[2] == at), default=None), min(ge, default=None))


def test_running_in_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0, 0, 0, 1]), rng.randint(-40, 40), rng.randint(0, 5), i, rng.randint(1, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, p bigint, q bigint, id int, v bigint")
    got = {r["id"]: (r["cum"], r["hi"]) for r in scans.running_in_order(df, ["k"], ["-p", "q"], ["id"], {"cum": ("v", "sum"), "hi": ("v", "max")}, bits=3).collect()}
    for k in (0, 1):
        cum = hi = 0
        for _, _, _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2], r[3])):
            cum, hi = cum + v, max(hi, v)
            assert got[i] == (cum, hi)


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(120)] + [(1000, n) for n in range(1001, 1200)] + [(5000, 5000)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = components.connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == {n: find(n) for n in parent}


def test_roots_and_cycle(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 50)], "c int, p int")
    assert {r["root"] for r in lookup.resolve_roots(links, "c", "p").collect()} == {0}
    with pytest.raises(ValueError):
        lookup.resolve_roots(spark.createDataFrame([(1, 2), (2, 1)], "c int, p int"), "c", "p")


def test_upper_median(spark):
    rows = [(k, v) for k, vs in {1: [5, 1, 9], 2: [4, 2], 3: [7, 7, 7, 1]}.items() for v in vs]
    got = {r["k"]: r["m"] for r in cohort.upper_median(spark.createDataFrame(rows, "k int, v bigint"), ["k"], "v", "m").collect()}
    assert got == {1: 5, 2: 4, 3: 7}


def test_diverse_subset(spark):
    rng = random.Random(8)
    pairs = {(a, b): rng.randint(1, 40) for a in range(25) for b in range(a + 1, 25)}
    df = spark.createDataFrame([("g", a, b, d) for (a, b), d in pairs.items()], "grp string, a int, b int, d bigint")
    left = set(range(25))
    while len(left) > 8:
        _, a, b = min((d, a, b) for (a, b), d in pairs.items() if a in left and b in left)
        left.discard(b)
    assert {r["leaf"] for r in similarity.diverse_subset(df, 8).collect()} == left


def test_sequence_representatives(spark):
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    base, other = make(400), make(300)
    rows = [("g", 1, base), ("g", 2, base), ("g", 3, base[:390]), ("g", 4, other), ("h", 5, base)]
    got = {r["id"]: r["representative"] for r in similarity.sequence_representatives(spark.createDataFrame(rows, "grp string, id int, seq string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_coding_spans_decide_overlap(spark):
    from strandframe.operators import genes

    chain = "array(named_struct('s', {}L, 'e', {}L))"
    gene = lambda g, s, e, cs, ce: spark.sql(
        f"SELECT 'a' AS seqid, '+' AS strand, '{g}' AS gene, '{g}t' AS tid, {s}L AS start, {e}L AS end, {chain.format(s, e)} AS chain, "
        + (f"{chain.format(cs, ce)} AS cds" if cs else f"filter({chain.format(s, e)}, x -> false) AS cds")
    )
    # g1 and g2 touch outside their coding parts only; g3 and g4 overlap in them; n is not coding
    rows = gene("g1", 1, 50, 10, 30).union(gene("g2", 40, 90, 60, 80)).union(gene("g3", 100, 200, 110, 150)).union(gene("g4", 140, 240, 149, 160)).union(gene("n", 1, 240, 0, 0))
    assert {r.gene for r in genes.adjacent_overlaps(rows).collect()} == {"g3", "g4"}
    assert {r.gene for r in genes.gene_filter(rows, drop_single_exon=False).collect()} == {"g1", "g2", "n"}
