"""Text inputs and outputs."""

from pyspark.sql import functions as F

from strandframe.functions import attributes as A
from strandframe.operators import genome
from strandframe.sources import annotation as N
from strandframe.sources import records as R


def test_annotation_round_trip(spark, data, tmp_path):
    feats = N.with_ids(N.features(N.read_lines(spark, f"{data}/host.gtf")))
    tx = N.assemble(feats)
    row = tx.first()
    assert tx.count() == 1 and len(row["chain"]) == 5 and len(row["cds"]) == 4 and row["start"] == 63137916
    assert N.dialect(spark, f"{data}/host.gtf") == "gtf"
    out = str(tmp_path / "gtf")
    lines = N.transcript_lines(tx.withColumn("attrs", A.parse_attributes(F.col("attributes"))))
    N.write_text(lines.orderBy("seqid", "start", "tid", "rank"), out)
    again = N.assemble(N.with_ids(N.features(N.read_lines(spark, out)))).first()
    assert again["chain"] == row["chain"] and again["cds"] == row["cds"]
    assert N.hierarchical_order(N.features(N.read_lines(spark, out))).first()["type"] == "transcript"
    table = N.attribute_table(N.features(N.read_lines(spark, f"{data}/host.gtf")), ["gene_name", "nothing"], ["seqid"]).first()
    assert (table["gene_name"], table["nothing"], table["seqid"]) == ("ELK4", "-", "1")


def test_attributes(spark):
    d = spark.createDataFrame([('a "1"; b "x y"; a "2"; broken; ',)], "t string")
    m = lambda keep: A.parse_attributes(F.col("t"), keep=keep)
    r = d.select(
        m("first").alias("f"), m("last").alias("l"), A.attribute(F.lit('ref_gene_id "r"; gene_id "g";'), "gene_id").alias("g"),
        A.add_value(m("first"), "a", F.lit("3")).alias("add"), A.rename_keys(m("first"), {"a": "z"}).alias("ren"),
        A.parse_attributes(F.lit("ID=t1;Parent=g1"), True).alias("gff"), A.numeric_id(F.lit("P.12.3")).alias("id"), A.numeric_id(F.lit("P.x.3")).alias("bad"),
        A.bump_suffix(F.lit("t.9")).alias("b1"), A.bump_suffix(F.lit("t")).alias("b2"), A.bump_suffix(F.lit("t.9"), 0).alias("b0"),
        A.float_list_sum(F.lit("1.5,2,x")).alias("s"), A.base_name(F.lit("/a/b/liver.gtf")).alias("n"), A.percent_decode(F.lit("a%20b+c")).alias("d"),
    ).first()
    assert r["f"] == {"a": "1", "b": "x y"} and r["l"]["a"] == "2" and r["g"] == "g" and r["add"]["a"] == "1,3" and r["ren"] == {"z": "1", "b": "x y"}
    assert r["gff"] == {"ID": "t1", "Parent": "g1"} and tuple(r["id"]) == (12, 3) and r["bad"] is None
    assert (r["b1"], r["b2"], r["b0"], r["s"], r["n"], r["d"]) == ("t.10", "t.0", "t.9", 3.5, "liver", "a b+c")


def test_gff_parents_and_subset(spark):
    lines = ["c\tx\tmRNA\t10\t1\t.\t+\t.\tID=t1;Parent=g1", "c\tx\tmRNA\t1\t10\t.\t+\t.\tID=t2;Parent=g1", "c\tx\texon\t1\t5\t.\t+\t.\tParent=t1,t2 # note", "bad line"]
    raw = spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, line_no bigint")
    feats = N.features(raw)
    assert feats.count() == 3 and feats.first()["start"] == 1
    tx = {r["tid"]: r for r in N.assemble(N.with_ids(feats, True)).collect()}
    assert set(tx) == {"t1", "t2"} and tx["t2"]["gene"] == "g1" and tuple(tx["t1"]["chain"][0]) == (1, 5)
    regions = spark.createDataFrame([("c", 1, 6, None)], "seqid string, lo bigint, hi bigint, strand string")
    assert [r["type"] for r in N.subset_by_region(feats, regions).collect()] == ["exon"]


def test_records(spark, tmp_path):
    fa = tmp_path / "a.fa"
    fa.write_text(">s1 first\nacgt\nAC\n>s2\nGG\n")
    assert {r["name"]: r["seq"] for r in R.read_fasta(spark, str(fa)).collect()} == {"s1": "ACGTAC", "s2": "GG"}
    chunks = genome.tiles(R.read_fasta(spark, str(fa)), 4).where("name = 's1'").orderBy("chunk_no").collect()
    assert [r["seq"] for r in chunks] == ["ACGT", "AC"]
    fq = tmp_path / "a.fq"
    fq.write_text("@r1 x\nAC\n+\n@@\n@r2\nGT\n+\nII\n@r1\nTT\n+\nJJ\n")
    assert {r["name"]: (r["seq"], r["quality"]) for r in R.read_fastq(spark, str(fq)).collect()} == {"r1": ("TT", "JJ"), "r2": ("GT", "II")}
    t = spark.createDataFrame([("T1\tL1\tg|t\t=\tq1:a|b|2|0.5|1.0|3.0|100,c|d|1||2|1|9\t-",)], "value string")
    rows = sorted(R.tracking_rows(t).collect(), key=lambda r: r["q_gid"])
    assert [(r["query"], r["q_gid"], r["fpkm"], r["tpm"]) for r in rows] == [("q1", "a", 0.5, 1.0), ("q1", "c", 0.0, 2.0)]


def test_tree(spark):
    t = spark.createDataFrame([(0, "((a:1,b:2)x:0.5,c:3);")], "line_no bigint, value string")
    rows = {r["name"]: r for r in R.tree_nodes(t).collect()}
    assert rows["a"]["parent"] == rows["b"]["parent"] == rows["x"]["node"] and rows["c"]["parent"] == 0
    assert rows["b"]["length"] == 2.0 and rows["a"]["is_leaf"] and not rows["x"]["is_leaf"]


def test_sampling_is_repeatable(spark):
    d = spark.range(1000)
    one = [r["id"] for r in R.stable_sample(d, ["id"], 0.2, 1).collect()]
    assert one == [r["id"] for r in R.stable_sample(d, ["id"], 0.2, 1).collect()] and 120 < len(one) < 280
    assert sorted(r["id"] for r in R.shuffled(d, ["id"], 3).collect()) == list(range(1000))


def test_semicolon_in_quotes(spark):
    d = spark.createDataFrame([('note "x;y"; b "1"; open "2',), (None,), ("",)], "t string")
    r = [x[0] for x in d.select(A.parse_attributes(F.col("t"), keep="last")).collect()]
    assert r == [{"note": "x;y", "b": "1", "open": "2"}, None, {}]


def test_lines_are_numbered_in_each_file(spark, tmp_path):
    made = {f"f{k}.txt": [f"{k}:{i}" + "x" * (i * 7 % 23) for i in range(n)] for k, n in enumerate((1601, 3, 0, 900))}
    for name, lines in made.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "100b")
    try:
        rows = N.read_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 20
        for few in (N.FEW_BLOCKS, 0):
            N.FEW_BLOCKS, kept = few, N.FEW_BLOCKS
            got = sorted((r["file"].rsplit("/", 1)[1], r["line_no"], r["value"]) for r in N.read_lines(spark, str(tmp_path)).collect())
            N.FEW_BLOCKS = kept
            assert got == sorted((name, i, x) for name, lines in made.items() for i, x in enumerate(lines))
        (tmp_path / "reads").mkdir()
        reads = {f"{p}{i}": ("ACGT"[i % 4] * (i % 50), "@+I~"[i % 4] * (i % 50)) for p in "ab" for i in range(300)}
        for p in "ab":
            (tmp_path / "reads" / f"{p}.fq").write_text("".join(f"@{p}{i} z\n{reads[f'{p}{i}'][0]}\n+\n{reads[f'{p}{i}'][1]}\n" for i in range(300)))
        assert {r["name"]: (r["seq"], r["quality"]) for r in R.read_fastq(spark, str(tmp_path / "reads")).collect()} == reads
        long = "ACGTN" * 1000
        (tmp_path / "s.fa").write_text(">s1 one\n" + "\n".join(long[i : i + 61] for i in range(0, 5000, 61)) + "\n\n>s2\n>s3\nacgt\n")
        tiles = sorted((r["name"], r["chunk_no"], r["seq"]) for r in genome.tiles_of_lines(N.read_lines(spark, str(tmp_path / "s.fa")), 64).collect())
        assert tiles == [("s1", i, long[64 * i : 64 * i + 64]) for i in range(79)] + [("s3", 0, "ACGT")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_phases_in_and_out(spark, tmp_path):
    line = lambda t, kind, s, e, st, ph: f'c\tx\t{kind}\t{s}\t{e}\t.\t{st}\t{ph}\tgene_id "g"; transcript_id "{t}";'
    text = []
    for p in (0, 1, 2):
        for st in "+-":
            t = f"t{p}{'f' if st == '+' else 'r'}"
            parts = [(10, 14), (20, 26), (30, 31)]
            text += [line(t, "transcript", 5, 40, st, "."), *[line(t, "exon", s, e, st, ".") for s, e in ((5, 14), (20, 26), (30, 40))]]
            before = 0
            for s, e in parts if st == "+" else parts[::-1]:
                text.append(line(t, "CDS", s, e, st, (p - before) % 3))
                before += e - s + 1
    text.append(line("bad", "CDS", 1, 3, "+", 2))
    text.append(line("bad", "CDS", 7, 9, "+", 1))
    lines = spark.createDataFrame([(x,) for x in text], "value string")
    tx = N.assemble(N.with_ids(N.features(lines)))
    rows = {r["tid"]: r for r in N.coding_transcripts(tx).collect()}
    assert rows["bad"]["phase"] == 2 and [tuple(x) for x in rows["bad"]["off_phase"]] == [(7, 9, 1)] and rows["t1f"]["off_phase"] == []
    assert [tuple(x) for x in rows["t1f"]["coding"]] == [(11, 14, 0), (20, 26, 2), (30, 31, 1)]
    assert [tuple(x) for x in rows["t1r"]["coding"]] == [(10, 14, 1), (20, 26, 2), (30, 30, 0)]
    N.write_transcripts(tx.where("tid <> 'bad'"), str(tmp_path / "out"))
    back = [r["value"] for p in sorted((tmp_path / "out").glob("part-*")) for r in spark.read.text(str(p)).collect()]
    swap = lambda x: x.replace('gene_id "g"; transcript_id', "transcript_id").replace('";', '"; gene_id "g";') if x else x
    assert sorted(back) == sorted(swap(x) for x in text[:-2])
    owners = [x.split('transcript_id "')[1][:3] for x in back]
    assert owners == sorted(owners) and [x.split("\t")[2] for x in back[:7]] == ["transcript"] + ["exon"] * 3 + ["CDS"] * 3
