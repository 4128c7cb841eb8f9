"""Queries over the plain tables: lookups, cohorts, attributes, sequences, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import attributes as A
from ..functions import sequences as Q
from ..operators import breakpoints, cohort, lookup
from ..sources import annotation, records
from .registry import query
from .views import stored_transcripts, table

# ---------------------------------------------------------------- cohorts: customer = sample, nation = tissue


def _samples(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderpriority")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return o.join(c, "o_custkey").join(n, "c_nationkey").select(
        F.col("o_orderpriority").alias("id"), F.col("n_name").alias("tissue"), F.floor(F.col("o_totalprice")).cast("bigint").alias("value")
    )


_SAMPLES = """s AS (SELECT o_orderpriority AS id, n_name AS tissue, CAST(floor(o_totalprice) AS BIGINT) AS value
 FROM orders JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey)"""


@query("cohort_stats", f"""WITH {_SAMPLES}, t AS (SELECT id, tissue, count(*) AS n FROM s GROUP BY 1,2),
a AS (SELECT id, count(*) AS n_tissues, CAST(sum(n) AS BIGINT) AS n_samples, round(avg(n),4) AS mean_samples, round(stddev_pop(n),4) AS sd_samples,
 list_sort(list(n)) AS l FROM t GROUP BY id),
v AS (SELECT id, round(avg(value),4) AS mean_value, round(stddev_pop(value),4) AS sd_value, list_sort(list(value)) AS l FROM s GROUP BY id)
SELECT a.id, n_tissues, n_samples, mean_samples, sd_samples, (a.l[(len(a.l)-1)//2+1] + a.l[len(a.l)//2+1])//2 AS median_samples,
 v.l[len(v.l)//2+1] AS median_value, mean_value, sd_value FROM a JOIN v USING (id)""")
def cohort_stats(spark, sf):
    out = cohort.cohort_stats(_samples(spark, sf))
    rounded = ("mean_samples", "sd_samples", "mean_value", "sd_value")
    return out.select(*[F.round(c, 4).alias(c) if c in rounded else F.col(c) for c in out.columns])


@query("threshold_counts", f"""WITH {_SAMPLES} SELECT id, count(DISTINCT tissue) FILTER (WHERE value>150000) AS tissues_pass, count(*) FILTER (WHERE value>150000) AS samples_pass,
 count(DISTINCT tissue) FILTER (WHERE value<=150000) AS tissues_fail, count(*) FILTER (WHERE value<=150000) AS samples_fail FROM s GROUP BY id""")
def threshold_counts(spark, sf):
    return cohort.threshold_counts(_samples(spark, sf), 150000)


@query("tracking_levels", """WITH r AS (SELECT l_returnflag AS tid, 'all' AS l0, l_linestatus AS l1, CAST(l_linenumber AS VARCHAR) AS l2,
 CAST(l_quantity AS BIGINT) AS tpm, CAST(l_extendedprice AS BIGINT) AS cov FROM lineitem),
u AS (SELECT tid, 0 AS level, l0 AS name, l0 AS path, tpm, cov FROM r UNION ALL SELECT tid, 1, l1, l0||'/'||l1, tpm, cov FROM r
 UNION ALL SELECT tid, 2, l2, l0||'/'||l1||'/'||l2, tpm, cov FROM r)
SELECT tid, CAST(level AS INT) AS level, name, path, round(avg(tpm),4) AS tpm_mean, round(avg(cov),4) AS cov_mean, count(*) AS num_samples FROM u GROUP BY 1,2,3,4""")
def tracking_levels(spark, sf):
    r = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("tid"), F.lit("all").alias("l0"), F.col("l_linestatus").alias("l1"), F.col("l_linenumber").cast("string").alias("l2"),
        F.round("l_quantity").cast("bigint").alias("tpm"), F.rint("l_extendedprice").cast("bigint").alias("cov"),
    )
    out = cohort.tracking_levels(r, ["l0", "l1", "l2"])
    return out.withColumn("tpm_mean", F.round("tpm_mean", 4)).withColumn("cov_mean", F.round("cov_mean", 4))


@query("tracking_rows", """SELECT CAST(o_orderkey AS VARCHAR) AS tid, 'c' || o_custkey AS loc, 'g' || o_custkey%50 AS ref_gid, o_orderstatus AS ref_tid, '=' AS code, q AS query,
 o_orderpriority AS q_gid, k AS q_tid, CAST(o_custkey%7 AS DOUBLE) AS n_exons, 0.0 AS fpkm, CAST(o_custkey%11 AS DOUBLE) AS tpm, CAST(o_custkey%13 AS DOUBLE) AS cov, 9.0 AS len
FROM orders, (VALUES ('q1','a'),('q1','b'),('q2','c')) v(q,k) WHERE NOT (q='q2' AND o_custkey%2=0)""")
def tracking_rows(spark, sf):
    o = table(spark, sf, "orders")
    one = lambda t: F.concat_ws("|", "o_orderpriority", F.lit(t), F.expr("o_custkey % 7"), F.lit(""), F.expr("o_custkey % 11"), F.expr("o_custkey % 13"), F.lit("9"))
    line = F.concat_ws(
        "\t", F.col("o_orderkey").cast("string"), F.concat(F.lit("c"), "o_custkey"), F.concat(F.expr("concat('g', o_custkey % 50)"), F.lit("|"), "o_orderstatus"),
        F.lit("="), F.concat(F.lit("q1:"), one("a"), F.lit(","), one("b")),
        F.when(F.col("o_custkey") % 2 == 0, "-").otherwise(F.concat(F.lit("q2:"), one("c"))),
    )
    return records.tracking_rows(o.select(line.alias("value")))


@query("root_of_chain", """WITH RECURSIVE c AS (SELECT DISTINCT conv_id, turn FROM conversations),
l AS (SELECT a.conv_id, a.turn, CASE WHEN b.turn IS NULL THEN a.turn ELSE b.turn END AS parent FROM c a LEFT JOIN c b ON a.conv_id=b.conv_id AND b.turn=a.turn-1),
r AS (SELECT conv_id, turn, parent AS node, parent=turn AS done FROM l UNION ALL SELECT r.conv_id, r.turn, l.parent, l.parent=r.node FROM r JOIN l ON l.conv_id=r.conv_id AND l.turn=r.node WHERE NOT r.done)
SELECT conv_id, turn, node AS root FROM r WHERE done""")
def root_of_chain(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn").distinct()
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.struct("conv_id", "turn").alias("parent"))
    links = c.join(prev, ["conv_id", "turn"]).select(F.struct("conv_id", "turn").alias("node"), "parent")
    roots = lookup.resolve_roots(links, "node", "parent")
    return c.join(roots.select("node.*", F.col("root.turn").alias("r")), ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("r", "turn").alias("root")
    )


# ---------------------------------------------------------------- lookups

@query("barcode_lookup", """SELECT p_partkey, coalesce(c_nationkey || 'x' || c_mktsegment, 'NaN') AS coord FROM part LEFT JOIN customer ON c_custkey=p_partkey""")
def barcode_lookup(spark, sf):
    # parts stand for barcodes: the larger ones have no place
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("p_partkey"), F.concat_ws("x", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("coord"))
    return lookup.lookup(table(spark, sf, "part").select("p_partkey"), c, "p_partkey", "coord").select("p_partkey", "coord")


@query("name_resolution", """WITH i AS (SELECT c_custkey, CASE c_custkey%3 WHEN 0 THEN n_name WHEN 1 THEN r_name ELSE c_mktsegment END AS id
 FROM customer JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey),
m AS (SELECT n_name, r_name, 'n' || n_nationkey AS target FROM nation JOIN region ON r_regionkey=n_regionkey),
l AS (SELECT n_name AS id, 0 AS k, target FROM m UNION ALL SELECT r_name, 1, target FROM m),
u AS (SELECT id, k, min(target) AS target FROM l GROUP BY 1,2 HAVING count(DISTINCT target)=1), b AS (SELECT id, arg_min(target, k) AS target FROM u GROUP BY id)
SELECT c_custkey, id, target FROM i LEFT JOIN b USING (id)""")
def name_resolution(spark, sf):
    names = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", "r_name", F.concat(F.lit("n"), "n_nationkey").alias("target")
    )
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").join(names.drop("target"), "n_nationkey")
    ids = c.select("c_custkey", F.expr("CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN r_name ELSE c_mktsegment END").alias("id"))
    return lookup.resolve_names(ids, names, ["n_name", "r_name"], "target").select("c_custkey", "id", "target")


# ---------------------------------------------------------------- annotation text built from orders

def _feature_lines(spark, sf):
    """Each order is one annotation line with repeated, odd and missing attributes."""
    o = table(spark, sf, "orders")
    attrs = F.concat(
        F.lit('transcript_id "'), F.col("o_orderkey"), F.lit('"; gene_id "g'), F.col("o_custkey"), F.lit('"; tag "'), F.col("o_orderpriority"),
        F.lit('"; tag "second"; broken; zz "'), F.col("o_orderstatus"), F.lit('";'),
    )
    return o.select(
        F.concat_ws(
            "\t", F.expr("concat('s', o_custkey % 5)"), F.lit("src"), F.when(F.col("o_orderkey") % 3 == 0, "exon").otherwise("transcript"),
            F.col("o_custkey").cast("string"), F.expr("cast(o_custkey + o_orderkey % 100 as string)"), F.lit("."), F.lit("+"), F.lit("."), attrs,
        ).alias("value")
    )


@query("feature_scan", """SELECT 's'||(o_custkey%5) AS seqid, CASE WHEN o_orderkey%3=0 THEN 'exon' ELSE 'transcript' END AS type, o_custkey AS "start", o_custkey+o_orderkey%100 AS "end",
 CAST(o_orderkey AS VARCHAR) AS tid, 'g'||o_custkey AS gene FROM orders""")
def feature_scan(spark, sf):
    return annotation.with_ids(annotation.features(_feature_lines(spark, sf))).select("seqid", "type", "start", "end", "tid", "gene")


@query("attr_parse", """SELECT o_orderkey AS id, k, v FROM (SELECT o_orderkey, unnest(['transcript_id','gene_id','tag','zz']) AS k,
 unnest([CAST(o_orderkey AS VARCHAR), 'g'||o_custkey, o_orderpriority, o_orderstatus]) AS v FROM orders)""")
def attr_parse(spark, sf):
    f = annotation.features(_feature_lines(spark, sf)).select(A.parse_attributes(F.col("attributes")).alias("m"))
    return f.select(F.element_at("m", "transcript_id").cast("bigint").alias("id"), F.explode("m").alias("k", "v"))


@query("attr_string", """SELECT o_orderkey AS id, 'transcript_id "' || o_orderkey || '"; gene_id "g' || o_custkey || '"; tag "' || o_orderpriority || '"; zz "' || o_orderstatus || '";' AS text,
 CASE WHEN o_orderkey%3=0 THEN 'Parent=' || o_orderkey ELSE 'ID=' || o_orderkey || ';Parent=g' || o_custkey END || ';tag=' || o_orderpriority || ';zz=' || o_orderstatus AS gff FROM orders""")
def attr_string(spark, sf):
    f = annotation.features(_feature_lines(spark, sf)).select("type", A.parse_attributes(F.col("attributes")).alias("m"))
    return f.select(
        F.element_at("m", "transcript_id").cast("bigint").alias("id"), A.attribute_text(F.col("m")).alias("text"),
        A.attribute_text(F.col("m"), F.col("type"), gff=True).alias("gff"),
    )


@query("attribute_values", """SELECT DISTINCT 'g'||o_custkey AS key, k AS attribute, v AS value FROM (SELECT o_custkey, unnest(['transcript_id','gene_id','tag','zz']) AS k,
 unnest([CAST(o_orderkey AS VARCHAR), 'g'||o_custkey, o_orderpriority, o_orderstatus]) AS v FROM orders WHERE o_orderkey%3<>0)""")
def attribute_values(spark, sf):
    return annotation.attribute_values(annotation.features(_feature_lines(spark, sf)), "gene_id")


@query("subset_by_gene", """SELECT CAST(o_orderkey AS VARCHAR) AS tid FROM orders WHERE o_orderkey%3<>0 AND o_custkey%10=1 OR o_orderkey%50=0""")
def subset_by_gene(spark, sf):
    feats = annotation.features(_feature_lines(spark, sf))
    gene = table(spark, sf, "customer").where("c_custkey % 10 = 1").select(F.concat(F.lit("g"), "c_custkey").alias("gene"))
    tids = table(spark, sf, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").cast("string").alias("tid"))
    return annotation.with_ids(annotation.subset(feats, genes=gene, tids=tids)).select("tid")


@query("subset_by_region", """SELECT o_orderkey AS id FROM orders o WHERE EXISTS (SELECT 1 FROM nation n WHERE 's'||(n_nationkey%5)='s'||(o_custkey%5)
 AND o_custkey >= n_nationkey*60 AND o_custkey+o_orderkey%100 <= n_nationkey*60+150)""")
def subset_by_region(spark, sf):
    regions = table(spark, sf, "nation").select(
        F.expr("concat('s', n_nationkey % 5)").alias("seqid"), (F.col("n_nationkey") * 60).cast("bigint").alias("lo"),
        (F.col("n_nationkey") * 60 + 150).cast("bigint").alias("hi"), F.lit(None).cast("string").alias("strand"),
    )
    out = annotation.subset_by_region(annotation.features(_feature_lines(spark, sf)), regions)
    return out.select(A.attribute(F.col("attributes"), "transcript_id").cast("bigint").alias("id"))


@query("selected_pages", "SELECT page_id, CAST(contains(lower(html), 'selen') OR contains(lower(html), 'exception') OR contains(lower(html), 'the') AS INT) AS hit FROM pages")
def selected_pages(spark, sf):
    t = F.col("html")
    hit = A.mentions(t, "selen") | A.mentions(t, "exception") | A.mentions(t, "the")
    return table(spark, sf, "pages").select("page_id", hit.cast("int").alias("hit"))


# ---------------------------------------------------------------- sequences: document letters mapped to bases

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BASES = "ACGTACGGTACTAGCATGCTATGACT"
_BOTH = _LETTERS + _LETTERS.upper(), _BASES + _BASES
_SEQ = f"regexp_replace(translate(text, '{_BOTH[0]}', '{_BOTH[1]}'), '[^ACGT]', 'T', 'g')"


def _sequences(spark, sf):
    """Every character of a document is a base: letters by the table, all others T."""
    seq = F.regexp_replace(F.translate("text", *_BOTH), "[^ACGT]", "T")
    return table(spark, sf, "documents").select("doc_id", "lang", seq.alias("seq"))


@query("revcomp", f"SELECT doc_id, reverse(translate({_SEQ}, 'ACGT', 'TGCA')) AS rc FROM documents")
def revcomp(spark, sf):
    return _sequences(spark, sf).select("doc_id", Q.reverse_complement(F.col("seq")).alias("rc"))


_CODON_VALUES = ", ".join(f"('{a}{b}{c}', '{Q.AMINO[16 * i + 4 * j + k]}')" for i, a in enumerate(Q.BASES) for j, b in enumerate(Q.BASES) for k, c in enumerate(Q.BASES))


@query("translate_seq", f"""WITH d AS (SELECT doc_id, regexp_extract_all({_SEQ}, '...') AS cod FROM documents), t(codon, aa) AS (VALUES {_CODON_VALUES}),
u AS (SELECT doc_id, unnest(cod) AS codon, generate_subscripts(cod, 1) AS i FROM d),
j AS (SELECT doc_id, string_agg(aa, '' ORDER BY i) AS aa FROM u JOIN t USING (codon) GROUP BY doc_id)
SELECT d.doc_id, coalesce(aa, '') AS aa FROM d LEFT JOIN j USING (doc_id)""")
def translate_seq(spark, sf):
    return _sequences(spark, sf).select("doc_id", Q.translate(F.col("seq")).alias("aa"))


@query("orf_find", f"""WITH c AS (SELECT doc_id, f, unnest(cod) AS codon, generate_subscripts(cod, 1) - 1 AS i
 FROM (SELECT doc_id, f, regexp_extract_all(substring({_SEQ}, f + 1), '...') AS cod FROM documents, range(3) t(f))),
n AS (SELECT *, min(i) FILTER (codon IN ('TAA','TAG','TGA')) OVER (PARTITION BY doc_id, f ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM c WHERE codon IN ('ATG','TAA','TAG','TGA')),
o AS (SELECT doc_id, i*3+f AS s, stop*3+f+2 AS e FROM n WHERE codon='ATG' AND stop IS NOT NULL)
SELECT doc_id, s, e FROM (SELECT *, max(e-s) OVER (PARTITION BY doc_id) AS m FROM o) WHERE e-s=m""")
def orf_find(spark, sf):
    o = _sequences(spark, sf).select("doc_id", F.explode(Q.longest_orfs("seq")).alias("o"))
    return o.select("doc_id", "o.s", "o.e")


@query("doc_filter", """SELECT doc_id FROM documents WHERE length(text) > 0 AND length(text) >= 50 AND length(text) <= 20000
 AND CAST(length(regexp_replace(text, '[ACGTacgt]', '', 'g')) AS DOUBLE) / length(text) <= 0.9""")
def doc_filter(spark, sf):
    return table(spark, sf, "documents").where(Q.passes_quality(F.col("text"), 50, 20000, 0.9)).select("doc_id")


@query("sequences_by_content", f"SELECT min(doc_id) AS first_id, count(*) AS n FROM (SELECT doc_id, {_SEQ} AS seq FROM documents) GROUP BY seq")
def sequences_by_content(spark, sf):
    s = _sequences(spark, sf).select(F.sha2("seq", 256).alias("k"), "doc_id")
    return s.groupBy("k").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).drop("k")


@query("random_sample_stable", f"SELECT o_orderkey, o_custkey FROM orders WHERE ('0x' || substr(md5(o_orderkey || ',7'), 1, 8))::BIGINT < {int(0.1 * 2**32)}")
def random_sample_stable(spark, sf):
    return records.stable_sample(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 0.1, 7)


@query("read_shuffle", "SELECT l_orderkey, l_partkey FROM lineitem")
def read_shuffle(spark, sf):
    return records.shuffled(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), ["l_orderkey"], 11)


# ---------------------------------------------------------------- breakpoints: orders are reads, line items alignments

def _breakpoint_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.expr("concat('r', l_orderkey)").alias("read_name"), F.expr("concat('h', l_partkey % 3)").alias("genome1_seqid"),
        F.expr("concat('p', l_suppkey % 2)").alias("genome2_seqid"), (F.col("l_partkey") % 40).alias("genome1_breakpoint"),
        (F.col("l_suppkey") % 30).alias("genome2_breakpoint"), F.expr("IF(l_linenumber % 2 = 0, 'g1', '-')").alias("junction1"),
        F.expr("IF(l_linenumber % 3 = 0, 'g2', '-')").alias("junction2"), F.col("l_returnflag").alias("gene1"), F.col("l_linestatus").alias("gene2"),
    )


_BP = """b AS (SELECT 'h'||(l_partkey%3) AS genome1_seqid, 'p'||(l_suppkey%2) AS genome2_seqid, l_partkey%40 AS genome1_breakpoint, l_suppkey%30 AS genome2_breakpoint,
 CASE WHEN l_linenumber%2=0 THEN 'g1' ELSE '-' END AS junction1, CASE WHEN l_linenumber%3=0 THEN 'g2' ELSE '-' END AS junction2, l_returnflag AS gene1, l_linestatus AS gene2 FROM lineitem)"""


@query("breakpoint_groups", f"WITH {_BP} SELECT *, count(*) AS count FROM b GROUP BY ALL")
def breakpoint_groups(spark, sf):
    return breakpoints.group_breakpoints(_breakpoint_rows(spark, sf))


@query("breakpoint_weights", f"""WITH {_BP}, w AS (SELECT *, 1 + (junction1<>'-')::INT + (junction2<>'-')::INT AS w FROM b)
SELECT seqid, pos, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT genome1_seqid AS seqid, genome1_breakpoint AS pos, w FROM w
 UNION ALL SELECT genome2_seqid, genome2_breakpoint, w FROM w) GROUP BY 1,2""")
def breakpoint_weights(spark, sf):
    return breakpoints.breakpoint_weights(_breakpoint_rows(spark, sf))


def _alignments(spark, sf, side: int):
    """Reads of 60 bases: the first part aligns to one genome, the last part to the other."""
    li = table(spark, sf, "lineitem").where(F.col("l_linenumber") % 2 == side)
    n = F.expr("cast(15 + l_partkey % 20 as int)")
    start = F.expr("l_orderkey div 40 * 200 + l_suppkey % 150")
    q = F.lit(1) if side == 0 else F.lit(60) - n + 1
    flip = F.col("l_suppkey") % 2 == 1
    btop = F.when(F.col("l_partkey") % 3 == 0, F.concat_ws("AC", F.lit(7).cast("string"), (n - 8).cast("string"))).otherwise(n.cast("string"))
    lo, hi = (start + 1).cast("bigint"), (start + n).cast("bigint")
    return li.select(
        F.expr("concat('r', l_orderkey)").alias("qseqid"), F.lit(60).cast("bigint").alias("qlen"), F.expr("concat('s', l_orderkey % 5)").alias("sseqid"),
        q.cast("bigint").alias("qstart"), (q + n - 1).cast("bigint").alias("qend"), F.when(flip, hi).otherwise(lo).alias("sstart"),
        F.when(flip, lo).otherwise(hi).alias("send"), btop.alias("btop"),
    )


@query("breakpoint_scan")
def breakpoint_scan(spark, sf):
    tx = stored_transcripts(spark, sf)
    return breakpoints.find_breakpoints(_alignments(spark, sf, 0), _alignments(spark, sf, 1), tx.where("is_template"), tx.where("NOT is_template"))
