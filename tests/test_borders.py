"""Cuts of many reads at a time against the definition pair by pair."""

import random

from pyspark.sql import functions as F

from strandframe.operators import borders
from strandframe.operators import breakpoints as B

SITES = "array<struct<pos:bigint,gene:string>>"
ROW = f"line string, qseqid string, qlen bigint, sseqid string, qstart bigint, qend bigint, sstart bigint, send bigint, btop string, donors {SITES}, acceptors {SITES}, hits array<struct<gene:string,exon:int>>"


def made(rng, n):
    """(read, alignments to one genome, to the other): gaps, mismatches, sites side by side, some values missing, some reads of two lengths."""
    def alignment(read, qlen):
        ops = "".join(rng.choice(["3", "1", "7", "AC", "-A", "C-", "--", "12"]) for _ in range(rng.randint(0, 5)))
        qstart, s = rng.randint(1, qlen), rng.randint(100, 140)
        e = s + rng.choice([-1, 1]) * rng.randint(0, qlen)
        fields = [read, qlen, f"s{rng.randint(0, 1)}", qstart, rng.randint(qstart, qlen), s, e, ops]
        if rng.random() < 0.05:
            fields[rng.randint(1, 7)] = None
        sites = lambda: [(p, rng.choice(["x", "y", None])) for p in sorted(rng.sample(range(80, 160), rng.randint(0, 25)))]
        return ("\t".join(str(f) for f in fields if f is not None), *fields, sites(), sites(), [])

    def side(read, qlen):
        found = []
        for _ in range(rng.randint(1, 3)):
            a = alignment(read, qlen + (rng.random() < 0.05))
            found.append(a)
            if rng.random() < 0.3:  # the same alignment in another bin
                found.append((*a[:9], [(200, "z")], [], []))
        return sorted(found, key=lambda x: (x[0], [(v is not None, v) for v in x[1:9]]))

    return [(f"r{i}", side(f"r{i}", q), side(f"r{i}", q)) for i, q in enumerate(rng.choices((1, 5, 9, 14), k=n))]


def test_cuts_of_many_reads(spark):
    rows = made(random.Random(5), 150)
    reads = spark.createDataFrame(rows, f"qseqid string, rows_1 array<struct<{ROW.replace(' string', ':string').replace(' bigint', ':bigint').replace(' array', ':array')}>>, rows_2 array<struct<{ROW.replace(' string', ':string').replace(' bigint', ':bigint').replace(' array', ':array')}>>")
    got = B.best_cuts(reads)
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
    fast = reads.select("qseqid", F.arrow_udf(borders.best_cuts(5, 3), borders.RESULT)("rows_1", "rows_2").alias("b"))
    assert 40 < fast.where("b IS NOT NULL").count() < 150

    one = lambda k: reads.select(F.col("qseqid").alias("_read"), F.explode(f"rows_{k}").alias("x")).select("_read", "x.*").drop("hits").groupBy("_read", "line", *B.FIELDS).agg(
        *[F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("donors", "acceptors")])
    tag = lambda p, k: p.select("_read", *[F.col(c).alias(f"{c}_{k}") for c in p.columns if c != "_read"])
    pairs = tag(one(1), 1).join(tag(one(2), 2), "_read").withColumn("genes_1", F.lit("-")).withColumn("genes_2", F.lit("-"))
    scored = B.score_pairs(B.with_ways(B.with_ways(pairs, "_1"), "_2"))
    cols = ["score", "genome1_read_breakpoint", "genome1_breakpoint", "genome2_breakpoint", "junction1", "junction2", "binread"]
    want = scored.groupBy("_read").agg(F.min_by(F.struct("line_1", "line_2", *cols), F.struct((-F.col("score")).alias("neg"), "line_1", "line_2", "trial")).alias("b"))
    line = lambda k, c: F.get(F.col(f"rows_{k}"), F.col(c))["line"]
    found = got.select(
        "qseqid", line(1, "best.one"), line(2, "best.two"), "best.score", F.col("best.cut").cast("bigint"), "best.place1", "best.place2",
        F.coalesce("best.junction1", F.lit("-")), F.coalesce("best.junction2", F.lit("-")), "best.binread",
    )
    assert sorted(map(tuple, found.collect())) == sorted((r._read, *r.b) for r in want.collect())
