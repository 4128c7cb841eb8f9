"""Queries on redundancy, loci, adoption, values along an axis, merged trackings and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chains as C
from ..operators import cohort, filters, genes, loci, runs, trees
from ..functions import attributes as A
from ..sources import annotation, records
from . import sqlviews as S
from .interval_queries import coding
from .registry import query
from .views import stored_transcripts, table, transcripts

_HELD = f"""{S.TX}, {S.classes("cl")},
hc AS (SELECT cl.*, coalesce(ic, '') AS ic, e1, sn FROM cl JOIN tx USING (tid) LEFT JOIN (SELECT tid, ic FROM ichain) USING (tid)),"""


@query("redundancy_collapse", f"""WITH {_HELD.replace(", e1, sn", ", tx.e1, tx.sn").replace("cl.*", "cl.tid, cl.seqid, cl.strand, cl.ts, cl.te, cl.nx")}
held AS (SELECT DISTINCT a.tid FROM hc a JOIN hc b ON a.seqid=b.seqid AND a.strand=b.strand AND a.tid<>b.tid AND a.ts<=b.te AND b.ts<=a.te
 AND (a.nx=1 OR contains(',' || b.ic || ',', ',' || a.ic || ','))
 WHERE EXISTS (SELECT 1 FROM exon x WHERE x.tid=b.tid AND x.s<=a.ts AND (CASE WHEN a.nx=1 THEN x.e>=a.te ELSE x.e=a.e1 END))
 AND EXISTS (SELECT 1 FROM exon x WHERE x.tid=b.tid AND x.e>=a.te AND (CASE WHEN a.nx=1 THEN x.s<=a.ts ELSE x.s=a.sn END)))
SELECT tid, chain FROM tx WHERE tid IN (SELECT tid FROM hc) AND tid NOT IN (SELECT tid FROM held)""")
def redundancy_collapse(spark, sf):
    return loci.collapse_redundant(stored_transcripts(spark, sf)).select("tid", C.as_text(F.col("chain")).alias("chain"))


@query("same_intron_collapse", f"""WITH {_HELD.replace(", e1, sn", ", tx.e1, tx.sn").replace("cl.*", "cl.tid, cl.seqid, cl.strand, cl.ts, cl.te, cl.nx")}
held AS (SELECT DISTINCT a.tid FROM hc a JOIN hc b ON a.seqid=b.seqid AND a.strand=b.strand AND a.tid<>b.tid AND a.ic=b.ic AND b.ts<=a.ts AND b.te>=a.te)
SELECT tid FROM hc WHERE tid NOT IN (SELECT tid FROM held)""")
def same_intron_collapse(spark, sf):
    return loci.collapse_redundant(stored_transcripts(spark, sf), all_introns=True).select("tid")


@query("identical_genes", f"""WITH {S.TX}, f AS (SELECT seqid, strand, chain, min(gene) AS same_as FROM tx GROUP BY 1,2,3)
SELECT DISTINCT gene, same_as FROM tx JOIN f USING (seqid, strand, chain) WHERE gene<>same_as""")
def identical_genes(spark, sf):
    return loci.identical_genes(transcripts(spark, sf))


_LOCI = f"""{S.TX}, ed AS (SELECT DISTINCT a.tid AS a, b.tid AS b FROM exon a JOIN exon b ON a.seqid=b.seqid AND a.strand=b.strand AND a.s<=b.e AND b.s<=a.e),
reach AS (SELECT tid, tid AS node FROM tx UNION SELECT r.tid, ed.b FROM reach r JOIN ed ON ed.a=r.node),
lo AS (SELECT r.tid, min(t.ts) AS locus FROM reach r JOIN tx t ON t.tid=r.node GROUP BY 1)"""


@query("loci", f"WITH RECURSIVE {_LOCI} SELECT tid, seqid, strand, locus FROM tx JOIN lo USING (tid)")
def locus_rows(spark, sf):
    return loci.loci(stored_transcripts(spark, sf))


@query("locus_summary", f"""WITH RECURSIVE {_LOCI}, t AS (SELECT tx.*, locus FROM tx JOIN lo USING (tid)),
g AS (SELECT seqid, strand, locus, gene, count(*) AS n FROM t GROUP BY ALL),
n AS (SELECT seqid, strand, locus, count(*) AS n_genes, max(n) AS n_gene, min(gene) FILTER (n = m) AS gene FROM (SELECT *, max(n) OVER (PARTITION BY seqid, strand, locus) AS m FROM g) GROUP BY ALL),
w AS (SELECT seqid, strand, locus, max(te) AS "end", count(*) AS n_tx, min(tid) FILTER (clen = m) AS main FROM (SELECT *, max(clen) OVER (PARTITION BY seqid, strand, locus) AS m FROM t) GROUP BY ALL)
SELECT seqid, strand, locus, "end", n_tx, gene, n_gene, n_genes, main FROM w JOIN n USING (seqid, strand, locus)""")
def locus_summary(spark, sf):
    return loci.locus_summary(stored_transcripts(spark, sf))


# parts are genes without children, from one base to 2,500
_GENES = """ge AS (SELECT 'p'||p_partkey AS gene, 's'||(p_partkey%5) AS seqid, CASE WHEN (p_partkey//5)%2=0 THEN '+' ELSE '-' END AS strand,
 p_partkey//10*375 AS s, p_partkey//10*375 + p_size*p_size AS e FROM part)"""


@query("adopted_transcripts", f"""WITH {S.TX}, {_GENES},
c AS (SELECT tid, ge.gene, row_number() OVER (PARTITION BY tid ORDER BY e-s, ge.gene) AS k FROM tx JOIN ge USING (seqid, strand) WHERE s<=ts AND e>=te)
SELECT tx.tid, c.gene FROM tx LEFT JOIN c ON c.tid=tx.tid AND k=1""")
def adopted_transcripts(spark, sf):
    p = F.col("p_partkey")
    start = F.expr("p_partkey div 10 * 375")
    genes = table(spark, sf, "part").select(
        F.concat(F.lit("p"), p).alias("gene"), F.expr("concat('s', p_partkey % 5)").alias("seqid"), F.expr("IF((p_partkey div 5) % 2 = 0, '+', '-')").alias("strand"),
        start.alias("start"), (start + F.col("p_size") * F.col("p_size")).alias("end"),
    )
    return loci.adopt_transcripts(stored_transcripts(spark, sf), genes)


_RUNS = """ru AS (SELECT 's'||(o_orderkey%5) AS seqid, o_orderkey//5*27 AS s, o_orderkey//5*27 + o_custkey%27 AS e, CAST(floor(o_totalprice) AS BIGINT)%1000 - 500 AS v FROM orders)"""


def _runs(spark, sf):
    s = F.expr("o_orderkey div 5 * 27")
    return table(spark, sf, "orders").select(
        F.expr("concat('s', o_orderkey % 5)").alias("seqid"), s.alias("s"), (s + F.expr("o_custkey % 27")).alias("e"), (F.floor("o_totalprice").cast("bigint") % 1000 - 500).alias("v")
    )


@query("run_statistics", f"""WITH {S.TX}, {_RUNS},
c AS (SELECT tid, sum(least(te, e) - greatest(ts, s) + 1) AS bases, sum(v*(least(te, e) - greatest(ts, s) + 1)) AS total, min(v) AS low, max(v) AS high
 FROM tx JOIN ru USING (seqid) WHERE s<=te AND e>=ts GROUP BY 1)
SELECT tid, CAST(coalesce(bases, 0) AS BIGINT) AS bases, round(coalesce(bases, 0)/(te-ts+1), 6) AS share, CAST(total AS BIGINT) AS total, round(total/bases, 6) AS mean, low, high
FROM tx LEFT JOIN c USING (tid)""")
def run_statistics(spark, sf):
    got = runs.interval_stats(stored_transcripts(spark, sf), _runs(spark, sf), "tid")
    return got.withColumn("share", F.round("share", 6)).withColumn("mean", F.round("mean", 6))


@query("run_values", f"WITH {S.TX}, {_RUNS} SELECT tid, ts AS pos, v FROM tx LEFT JOIN ru ON ru.seqid=tx.seqid AND s<=ts AND e>=ts")
def run_values(spark, sf):
    return runs.values_at(transcripts(spark, sf).select("tid", "seqid", F.col("start").alias("pos")), _runs(spark, sf), "pos").select("tid", "pos", "v")


_TRACK = """x AS (SELECT 'T'||(o_custkey%50) AS tid, n_name AS tissue, o_custkey%11+1 AS tpm, o_orderkey%13+1 AS cov FROM orders JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey),
u AS (SELECT tid, 'all' AS name, tpm, cov FROM x UNION ALL SELECT tid, tissue, tpm, cov FROM x),
v AS (SELECT tid, name, avg(tpm) AS tpm_mean, avg(cov) AS cov_mean, CAST(count(*) AS DOUBLE) AS num_samples FROM u GROUP BY 1,2)"""


@query("tracking_combined", f"""WITH {_TRACK}, k AS (UNPIVOT v ON tpm_mean, cov_mean, num_samples INTO NAME what VALUE value)
SELECT tid, name || '_' || what AS key, round(value, 4) AS value FROM k
UNION ALL SELECT DISTINCT 'T'||(c_custkey%50), 'rank', CAST(c_custkey%50 AS DOUBLE) FROM customer""")
def tracking_combined(spark, sf):
    """Customers are transcripts of a tissue, merged into one of fifty over all; orders are samples.  The values end up in annotation lines."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    name = lambda p, k: F.concat(F.lit(p), k)
    zero, big = F.lit(0.0), lambda x: x.cast("double")
    merged = name("T", F.col("c_custkey") % 50)
    top = c.select(F.array(F.lit("all")).alias("path"), merged.alias("tid"), name("m", F.col("c_custkey")).alias("q_tid"), zero.alias("fpkm"), zero.alias("tpm"), zero.alias("cov"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(c, "c_custkey").join(n, "c_nationkey")
    low = o.select(
        F.array(F.lit("all"), "n_name").alias("path"), name("m", F.col("c_custkey")).alias("tid"), name("q", F.col("o_orderkey")).alias("q_tid"), F.lit(1.0).alias("fpkm"),
        big(F.col("c_custkey") % 11 + 1).alias("tpm"), big(F.col("o_orderkey") % 13 + 1).alias("cov"),
    )
    text = lambda kind: F.concat_ws("\t", F.lit("c"), F.lit("x"), F.lit(kind), F.lit("1"), F.lit("9"), F.lit("."), F.lit("+"), F.lit("."),
                                    F.concat(F.lit('transcript_id "'), "tid", F.lit('"; rank "'), F.substring("tid", 2, 9), F.lit('";')))
    tids = c.select(merged.alias("tid")).distinct()
    feats = annotation.features(tids.select(F.explode(F.array(text("transcript"), text("exon"))).alias("value")))
    out = cohort.with_tracking(feats, top.unionByName(low)).where("type = 'transcript'").select(A.parse_attributes(F.col("attributes")).alias("m"))
    pairs = out.select(F.element_at("m", "transcript_id").alias("tid"), F.explode("m").alias("key", "value")).where("key <> 'transcript_id'")
    return pairs.select("tid", "key", F.round(F.col("value").cast("double"), 4).alias("value"))


@query("pruned_trees", """WITH k AS (SELECT o_custkey AS tree, o_orderpriority AS p, o_orderkey AS o, o_orderkey%7+1 AS len, o_custkey%5+1 AS plen FROM orders WHERE o_orderstatus<>'F'),
c AS (SELECT tree, p, plen, count(*) AS n, min(o) AS o1, min(len) AS l1, string_agg('o'||o||':'||CAST(len AS DOUBLE), ',' ORDER BY o) AS kids FROM k GROUP BY 1,2,3),
r AS (SELECT tree, count(*) AS m, sum(n) AS n, min(o1) AS o1, min(p) AS p1, min(kids) AS kids1,
 string_agg(CASE WHEN n=1 THEN 'o'||o1||':'||CAST(l1+plen AS DOUBLE) ELSE '('||kids||')'||p||':'||CAST(plen AS DOUBLE) END, ',' ORDER BY p) AS whole FROM c GROUP BY 1)
SELECT tree, CASE WHEN n=1 THEN 'o'||o1 WHEN m=1 THEN '('||kids1||')'||p1 ELSE '('||whole||')c'||tree END || ';' AS value FROM r""")
def pruned_trees(spark, sf):
    """Each customer is a tree of priorities and orders; what is not finished stays."""
    o = table(spark, sf, "orders")
    leaf = F.concat(F.lit("o"), "o_orderkey", F.lit(":"), F.col("o_orderkey") % 7 + 1)
    clade = o.groupBy("o_custkey", "o_orderpriority").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", leaf.alias("t")))), lambda x: x["t"]), ",").alias("kids"))
    clade = clade.select("o_custkey", F.struct("o_orderpriority", F.concat(F.lit("("), "kids", F.lit(")"), "o_orderpriority", F.lit(":"), F.col("o_custkey") % 5 + 1).alias("t")).alias("x"))
    text = clade.groupBy("o_custkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    line = F.concat(F.lit("("), F.array_join(F.transform("xs", lambda x: x["t"]), ","), F.lit(")c"), "o_custkey", F.lit(";"))
    nodes = records.tree_nodes(text.select(F.col("o_custkey").alias("line_no"), line.alias("value"))).withColumnRenamed("line_no", "tree")
    kept = o.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("tree"), F.concat(F.lit("o"), "o_orderkey").alias("name"))
    return trees.newick(trees.prune(nodes, kept))


@query("filtered_records", f"""WITH {S.TX}, {S.CDS}, {_GENES}
SELECT tid FROM tx WHERE clen>=30 AND nx>1 AND tid NOT IN (SELECT tid FROM intr WHERE e-s-1>60) AND tid IN (SELECT tid FROM cds) AND tid NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus='P')
 AND EXISTS (SELECT 1 FROM intr i JOIN intr j ON i.seqid=j.seqid AND i.strand=j.strand AND i.s=j.s AND i.e=j.e AND j.is_template WHERE i.tid=tx.tid)""")
def filtered_records(spark, sf):
    """Coding records of several exons without long introns, partly finished orders left out, with an intron that a template has."""
    tx = coding(stored_transcripts(spark, sf))
    known = tx.where("is_template").select("seqid", "strand", F.explode(C.introns(F.col("chain"))).alias("x")).select("seqid", "strand", "x.s", "x.e")
    drop = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("tid"))
    return filters.record_filter(tx, exclude=drop, min_bases=30, max_intron=60, multi_exon=True, coding=True, junctions=known).select("tid")


@query("region_coordinates", f"""WITH {S.TX}, r AS (SELECT tid, s, e, tid//40*200 AS lo, tid//40*200+400 AS hi, strand='-' AS flip FROM exon)
SELECT tid, string_agg(CASE WHEN flip THEN hi-e+1 ELSE s-lo+1 END || '-' || CASE WHEN flip THEN hi-s+1 ELSE e-lo+1 END, ',' ORDER BY CASE WHEN flip THEN -s ELSE s END) AS inside,
 string_agg(s||'-'||e, ',' ORDER BY s) AS back FROM r GROUP BY 1""")
def region_coordinates(spark, sf):
    lo, flip = F.expr("tid div 40 * 200"), F.col("strand") == "-"
    moved = transcripts(spark, sf).withColumn("inside", filters.to_region(F.col("chain"), lo, lo + 400, flip))
    return moved.select("tid", C.as_text(F.col("inside")).alias("inside"), C.as_text(filters.from_region(F.col("inside"), lo, lo + 400, flip)).alias("back"))


@query("gene_flags", "SELECT p_partkey, p_partkey%7=0 AS alt, p_size%5=0 OR (p_partkey%3=0 AND p_size%2=1) OR p_partkey%11=0 AS pseudo FROM part")
def gene_flags(spark, sf):
    """Parts as genes: some on alternative contigs, some pseudogenes by their type, a flag or a biotype."""
    p = table(spark, sf, "part")
    k, n = F.col("p_partkey"), F.col("p_size")
    seqid = F.concat(F.lit("c"), k % 5, F.when(k % 7 == 0, "_alt1").otherwise(""))
    attrs = F.concat(
        F.lit('gene_id "'), k, F.lit('"; is_pseudo "'), F.when((k % 3 == 0) & (n % 2 == 1), "True").otherwise("no"), F.lit('"; gene_type "'),
        F.when(k % 11 == 0, "processed_pseudogene").otherwise("not pseudogene here"), F.lit('";'),
    )
    kind = F.when(n % 5 == 0, "pseudogenic_region").otherwise("gene")
    feats = annotation.features(p.select("p_partkey", F.concat_ws("\t", seqid, F.lit("x"), kind, k.cast("string"), (k + n).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attrs).alias("value")))
    return feats.select("p_partkey", filters.on_alt_contig(F.col("seqid")).alias("alt"), filters.is_pseudogene(F.col("type"), A.parse_attributes(F.col("attributes"))).alias("pseudo"))


@query("united_bundles", f"""WITH {S.BUNDLE} SELECT seqid, strand, bundle AS bundle_start, max(te) AS bundle_end, count(*) AS n_tx, CAST(sum(is_template::INT) AS BIGINT) AS n_templates FROM bundle GROUP BY ALL""")
def united_bundles(spark, sf):
    """Queries and templates as two annotations, united and bundled."""
    from ..operators import islands

    tx = stored_transcripts(spark, sf)
    both = filters.united(tx.where("NOT is_template").drop("is_template"), tx.where("is_template").drop("is_template", "gene"))
    return islands.bundle_summary(both)


@query("gene_lines", f"""WITH {S.TX}, n AS (SELECT *, 'n'||(tid%4) AS name, CASE WHEN tid%3=0 THEN 'nc' ELSE 'coding' END AS kind FROM tx),
g AS (SELECT gene, min(seqid) AS seqid, min(ts) AS s, max(te) AS e, CASE WHEN count(DISTINCT strand)=1 THEN min(strand) ELSE '.' END AS strand,
 string_agg(DISTINCT name, ', ' ORDER BY name) AS names, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds FROM n GROUP BY 1),
d AS (SELECT gene, count(*) AS k, min(n_name) AS one, string_agg(name||' : '||n_name, ', ' ORDER BY name) AS many FROM (SELECT DISTINCT gene, name FROM n) JOIN nation ON name='n'||n_nationkey AND n_nationkey%2=0 GROUP BY 1)
SELECT g.gene, seqid || chr(9) || 'strandframe' || chr(9) || 'gene' || chr(9) || s || chr(9) || e || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9) || 'gene_id "' || g.gene || '"; gene_type "' || kinds
 || '"; gene_name "' || names || '";' || CASE WHEN k IS NULL THEN '' WHEN k=1 THEN ' description "'||one||'";' ELSE ' description "'||many||'";' END AS value FROM g LEFT JOIN d USING (gene)""")
def gene_lines(spark, sf):
    tx = stored_transcripts(spark, sf).withColumn("gene_name", F.expr("concat('n', tid % 4)")).withColumn("gene_type", F.expr("IF(tid % 3 = 0, 'nc', 'coding')"))
    known = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("description"))
    return genes.gene_lines(tx, known).select("gene", "value")


_KINDS = {"mRNA": "transcript", "five_prime_UTR": "exon", "CDS": "CDS", "coding_exon": "exon", "Stop_codon": "stop_codon", "start_codon": "start_codon", "stop_cds": "stop_codon", "intron": "intron",
          "pseudogene": "gene", "gene_segment": "gene", "lnc_RNA": "transcript", "region": None, "primary_transcript": "transcript"}


@query("feature_classes", "SELECT p_partkey, CASE p_size%13 " + " ".join(f"WHEN {i} THEN {repr(c or k)}" for i, (k, c) in enumerate(_KINDS.items())) + " END AS type FROM part")
def feature_classes(spark, sf):
    """Parts as features of thirteen spellings."""
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    p = table(spark, sf, "part").select("p_partkey", F.get(kinds, F.col("p_size") % 13).alias("type"))
    return annotation.by_class(p).select("p_partkey", "type")
