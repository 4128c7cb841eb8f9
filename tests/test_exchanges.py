"""What goes through exchanges: rows and columns stay few where results do not need more."""

import re

from pyspark.sql import functions as F

from strandframe.functions import chains as C
from strandframe.operators import breakpoints as B
from strandframe.operators import labels, scans, transfer
from strandframe.sources import annotation, records


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tx_rows(spark, n=40):
    rows = [(t, "s", "+", t % 2 == 0, [(100 * (t // 8) + t % 3, 100 * (t // 8) + 20), (100 * (t // 8) + 40, 100 * (t // 8) + 60 + t % 5)]) for t in range(n)]
    tx = spark.createDataFrame(rows, f"tid long, seqid string, strand string, is_template boolean, chain {C.CHAIN}")
    return tx.withColumn("start", C.chain_start(F.col("chain"))).withColumn("end", C.chain_end(F.col("chain")))


def test_ends_carry_no_chains(spark):
    """Keys and bounds of both ends are numbers, so no exchange of the search holds a chain; one search serves both ends."""
    got = labels.correct_ends(tx_rows(spark), threshold=40, max_extend=20)
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Window") <= 4 and "introns" not in text
    assert got.count() == 20


def test_a_pair_leaves_one_trial_per_direction(spark):
    cols = "_read string, qseqid_1 string, sseqid_1 string, line_1 string, genes_1 string, sseqid_2 string, line_2 string, genes_2 string"
    side = "array<struct<bases:array<bigint>,places:array<bigint>,donors:array<struct<i:int,label:string>>,acceptors:array<struct<i:int,label:string>>>>"
    one = [([1, 1, 1, 0, 0], [5, 6, 7, 8, 9], [(2, "d")], [(3, "e")])] * 2
    two = [([0, 0, 0, 1, 1], [5, 6, 7, 8, 9], [(1, "d")], [(3, "e")])] * 2
    df = spark.createDataFrame([("r", "r", "h", "l1", "-", "p", "l2", "-", one, two)], f"{cols}, ways_1 {side}, ways_2 {side}")
    got = B.score_pairs(df).collect()
    assert len(got) == 2 and all(abs(r.score - sum(map(int, r.binread)) / len(r.binread)) < 1e-12 for r in got)
    assert got[0].junction1 == "d" and got[0].junction2 == "e"


def test_genes_and_sites_by_bins(spark):
    """Spans over many bins, sites at the edge of the reach, a gene without a name, an alignment without a place."""
    aln = spark.createDataFrame(
        [("r1", 10, "h", 1, 10, 1000, 1009, "10"), ("r2", 10, "h", 1, 10, 5009, 5000, "10"), ("r3", 10, "h", 1, 10, None, None, "10")],
        "qseqid string, qlen long, sseqid string, qstart long, qend long, sstart long, send long, btop string",
    )
    sites = spark.createDataFrame([("h", 990, "d", "x"), ("h", 989, "d", "x"), ("h", 1019, "a", "y"), ("h", 1020, "a", "y")], "seqid string, pos long, kind string, gene string")
    spans = spark.createDataFrame([("h", 1, 9000, "x", 0), ("h", 1004, 1005, "x", 1), ("h", 1009, 1100, "z", 1), ("h", 5000, 5001, None, 1)], "seqid string, gs long, ge long, gene string, exon int")
    got = {r.qseqid: r for r in B.profile(aln, sites, spans).collect()}
    assert [tuple(x) for x in got["r1"].donors] == [(990, "x")] and [tuple(x) for x in got["r1"].acceptors] == [(1019, "y")]
    assert [got[r].genes for r in ("r1", "r2", "r3")] == ["x:exon", "x:intron", "-"]
    # a span is a row for each bin of its own, however many transcripts of its gene share it
    many = spans.select("seqid", F.explode(F.sequence(F.lit(1), F.lit(300))).alias("gs"), "ge", "gene", "exon").where("gene = 'x' AND exon = 0")
    assert B._bins(sites.where("false"), many).agg(F.max(F.size("spans"))).first()[0] == 1


def test_fits_are_computed_once(spark):
    """The shared part of a pair of chains stands once in the plan, not again in its filters."""
    tx = tx_rows(spark).withColumn("cds", F.col("chain"))
    text = transfer.fitted_chains(tx)._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in text.split("\n") if re.search(r"\bFilter\b", x)]
    assert not any("arrays_overlap" in x or x.count("transform(") for x in filters)


def test_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([('s\tx\texon\t1\t9\t.\t+\t.\ttranscript_id "t"; gene_id "g";',)], "value string")
    text = annotation.assemble(annotation.with_ids(annotation.features(lines)))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("#.*$") == 1


def test_only_keys_of_several_blocks_hand_on(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1 << 21, 2), ("b", 3, 1), ("b", 4, 7)], "k string, p long, v long")
    out = scans.running(df, ["k"], "p", {"m": ("v", "max"), "n": ("v", "sum")})
    assert "isnotnull(_c_m" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.k, r.p): (r.m, r.n) for r in out.collect()} == {("a", 1): (None, 0), ("a", 1 << 21): (5, 5), ("b", 3): (None, 0), ("b", 4): (1, 1)}


def test_trees_are_handed_over_in_batches(spark):
    """Nodes of many trees come as few tables; a larger batch than one table is cut."""
    assert records.TREE_ROWS >= 1000
    n = 9000
    lines = spark.range(n).select(F.col("id").alias("line_no"), F.expr("concat('(a', id, ':1,b)c', id, ';')").alias("value")).coalesce(1)
    got = records.tree_nodes(lines)
    assert got.agg(F.count("*"), F.count_if("is_leaf"), F.countDistinct("name")).first() == (3 * n, 2 * n, 2 * n + 1)


def test_touching_exons_take_one_exchange(spark, tmp_path):
    """It used to run blocked windows with five sorts and hash tables in a task."""
    from strandframe.plans import views

    rows = [(1, 0, 2.0), (1, 0, None), (1, 1, None), (1, 2, 3.0), (1, 2, 2.0), (2, 0, None), (None, 0, 2.0), (3, None, 2.0)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = views.touching_exons(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 0, 5), (1, 15, None), (1, 30, 39), (2, 0, None)]
    fresh = plan(views.touching_exons(spark, str(tmp_path)))
    assert fresh.count("Exchange") == 1 and "Window" not in fresh
