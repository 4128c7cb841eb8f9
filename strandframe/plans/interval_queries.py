"""Queries over the interval views: merging, bundles, introns, pairs, labels, genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chains as C
from ..operators import curves, genes, islands, labels, pairs, sets, splicing
from ..operators.pairs import AXIS
from ..operators.ranges import overlap_join
from . import sqlviews as S
from .registry import query
from ..session import stored
from .views import axis_columns, exons, raw_exons, stored_transcripts, touching_exons, transcripts


def coding(tx: DataFrame) -> DataFrame:
    """Two of three transcripts are coding; the coding range spares two bases at each end."""
    cds = F.when(F.col("tid") % 3 != 0, C.clip(F.col("chain"), F.col("start") + 2, F.col("end") - 2)).otherwise(C.empty_chain())
    return tx.withColumn("cds", cds)


def numbered_ids(tx: DataFrame) -> DataFrame:
    return tx.withColumn("gid", F.expr("(tid div 40) * 10 + tid % 10")).withColumn("num", F.expr("(tid % 40) div 10"))


# ---------------------------------------------------------------- merging and bundles

@query("bundle_summary", f"""WITH {S.BUNDLE}
SELECT seqid, strand, bundle AS bundle_start, max(te) AS bundle_end, count(*) AS n_tx,
 CAST(sum(CASE WHEN is_template THEN 1 ELSE 0 END) AS BIGINT) AS n_templates
FROM bundle GROUP BY seqid, strand, bundle""")
def bundle_summary(spark, sf):
    return islands.bundle_summary(transcripts(spark, sf))


@query("bundle_summary_open", f"""WITH {S.TX},
l AS (SELECT *, max(te) OVER (PARTITION BY seqid ORDER BY ts, te, tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM tx),
r AS (SELECT *, max(CASE WHEN m IS NULL OR ts >= m THEN ts END) OVER (PARTITION BY seqid ORDER BY ts, te, tid ROWS UNBOUNDED PRECEDING) AS b FROM l)
SELECT seqid, b AS bundle_start, max(te) AS bundle_end, count(*) AS n_tx,
 CAST(sum(CASE WHEN is_template THEN 1 ELSE 0 END) AS BIGINT) AS n_templates FROM r GROUP BY seqid, b""")
def bundle_summary_open(spark, sf):
    return islands.bundle_summary(transcripts(spark, sf), ["seqid"], gap=-1)


@query("bundle_members", f"WITH {S.BUNDLE} SELECT tid, seqid, strand, bundle FROM bundle")
def bundle_members(spark, sf):
    tx = stored_transcripts(spark, sf).select("tid", *AXIS, "start", "end")
    return islands.assign_islands(tx, AXIS, "start", "end", out="bundle").select("tid", *AXIS, "bundle")


@query("merged_exons", f"WITH {S.EXON} SELECT tid, s, e FROM exon")
def merged_exons(spark, sf):
    return exons(spark, sf).select("tid", "s", "e")


@query("merged_exons_inclusive", f"WITH {S.RAW}, {S.merged('m', 'raw', 'tid', 1)} SELECT tid, s, e FROM m")
def merged_exons_inclusive(spark, sf):
    return touching_exons(spark, sf)


@query("covered_segments", f"WITH {S.EXON}, {S.merged('m', 'exon', 'seqid, strand')} SELECT seqid, strand, s, e FROM m")
def covered_segments(spark, sf):
    return islands.merge_intervals(exons(spark, sf), AXIS)


# ---------------------------------------------------------------- introns and chains

@query("introns_boundary", f"WITH {S.TX} SELECT tid, seqid, strand, s, e FROM intr")
def introns_boundary(spark, sf):
    return splicing.intron_rows(transcripts(spark, sf))


@query("introns_base", f"WITH {S.TX} SELECT tid, seqid, strand, s+1 AS s, e-1 AS e FROM intr")
def introns_base(spark, sf):
    return splicing.intron_rows(transcripts(spark, sf), "base")


@query("introns_unique", f"WITH {S.TX} SELECT seqid, strand, s, e, count(*) AS n_tids, min(tid) AS first_tid FROM intr GROUP BY ALL")
def introns_unique(spark, sf):
    return splicing.unique_introns(transcripts(spark, sf))


@query("tx_chains", f"WITH {S.TX} SELECT tid, chain AS chain_str, CAST(nx AS INT) AS n_exons, clen AS chain_len FROM tx")
def tx_chains(spark, sf):
    c = F.col("chain")
    return transcripts(spark, sf).select(
        "tid", C.as_text(c).alias("chain_str"), F.size(c).alias("n_exons"), C.chain_length(c).alias("chain_len")
    )


@query("tx_cigar", f"""WITH {S.TX}, g AS (SELECT tid, s, e, lag(e) OVER (PARTITION BY tid ORDER BY s) AS p FROM exon)
SELECT tid, string_agg(coalesce((s-p-1)||'N','') || (e-s+1) || 'M', '' ORDER BY s) AS cigar FROM g GROUP BY tid""")
def tx_cigar(spark, sf):
    return transcripts(spark, sf).select("tid", C.cigar(F.col("chain")).alias("cigar"))


@query("phases_fwd_rev", f"""WITH {S.TX}, a AS (SELECT tid, s, e, coalesce(CASE WHEN strand='+'
 THEN sum(e-s+1) OVER (PARTITION BY tid ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
 ELSE sum(e-s+1) OVER (PARTITION BY tid ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, 0) AS n FROM exon)
SELECT tid, s, e, CAST((3 - n%3)%3 AS INT) AS phase FROM a""")
def phases_fwd_rev(spark, sf):
    ph = F.explode(C.phases(F.col("chain"), F.col("strand"))).alias("p")
    return transcripts(spark, sf).select("tid", ph).select("tid", "p.*")


@query("exon_clip", f"""WITH {S.TX} SELECT x.tid, greatest(s, ts+7) AS s, least(e, te-7) AS e, CAST(1 AS INT) AS one_base_kept
 FROM exon x JOIN tx USING (tid) WHERE greatest(s, ts+7) <= least(e, te-7)
UNION ALL SELECT x.tid, greatest(s, ts+7), least(e, te-7), 0
 FROM exon x JOIN tx USING (tid) WHERE greatest(s, ts+7) < least(e, te-7)""")
def exon_clip(spark, sf):
    tx = stored_transcripts(spark, sf)
    cut = lambda m, flag: splicing.explode_chain(
        tx, C.clip(F.col("chain"), F.col("start") + 7, F.col("end") - 7, m), ["tid"]
    ).withColumn("one_base_kept", F.lit(flag))
    return cut(1, 1).unionByName(cut(2, 0))


@query("genome_positions", f"""WITH {S.TX}, c AS (SELECT x.tid, x.strand, x.s, x.e, t.clen,
  coalesce(sum(x.e-x.s+1) OVER (PARTITION BY x.tid ORDER BY x.s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS b
 FROM exon x JOIN tx t USING (tid)), o AS (SELECT tid, CASE WHEN strand='+' THEN least(10, clen-1) ELSE clen-1-least(10, clen-1) END AS off FROM tx)
SELECT tid, CAST(s + off - b AS BIGINT) AS pos FROM c JOIN o USING (tid) WHERE off >= b AND off < b + (e-s+1)""")
def genome_positions(spark, sf):
    pos = C.to_genome(F.col("chain"), F.col("strand"), F.lit(10))
    return transcripts(spark, sf).select("tid", pos.alias("pos"))


# ---------------------------------------------------------------- pairs

_PAIRS = f"""WITH {S.TX}, {S.classes()},
pp AS (SELECT a.seqid, a.strand, a.tid AS tid1, b.tid AS tid2, a.n AS n1, b.n AS n2, a.ts AS ts1, a.te AS te1, b.ts AS ts2, b.te AS te2,
  a.nx AS nx1, b.nx AS nx2 FROM cls a JOIN cls b ON a.seqid=b.seqid AND a.strand=b.strand AND a.ts<=b.te AND b.ts<=a.te
  AND (a.ts<b.ts OR (a.ts=b.ts AND a.tid<b.tid) OR (a.tid=b.tid AND a.n>1))),
{S.relations('rel', 'pp')}"""


@query("pair_status", f"""{_PAIRS}
SELECT seqid, strand, tid1, tid2, n1, n2, CAST(status AS INT) AS status, bp AS bases, least(te1,te2)-greatest(ts1,ts2)+1 AS span_bases,
 CAST(sh AS INT) AS shared_introns, CAST(nx1-1 AS INT) AS introns1, CAST(nx2-1 AS INT) AS introns2 FROM rel""")
def pair_status(spark, sf):
    return pairs.classify_pairs(stored_transcripts(spark, sf))


@query("overlap_pairs", f"""WITH {S.TX}, {S.classes()}
SELECT a.tid AS tid1, b.tid AS tid2, least(a.te,b.te)-greatest(a.ts,b.ts)+1 AS span_bp
FROM cls a JOIN cls b ON a.seqid=b.seqid AND a.strand=b.strand AND a.ts<=b.te AND b.ts<=a.te AND (a.ts<b.ts OR (a.ts=b.ts AND a.tid<b.tid))""")
def overlap_pairs(spark, sf):
    from ..operators.ranges import self_overlap

    cls = pairs.chain_classes(stored_transcripts(spark, sf)).select(*AXIS, "tid", "start", "end")
    return self_overlap(cls, AXIS, "tid").select(
        F.col("l_tid").alias("tid1"), F.col("r_tid").alias("tid2"),
        (F.least("l_end", "r_end") - F.greatest("l_start", "r_start") + 1).alias("span_bp"),
    )


@query("pair_singletons", f"""WITH {S.TX},
l AS (SELECT *, max(te) OVER (PARTITION BY seqid ORDER BY ts, te, tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM tx),
r AS (SELECT *, max(CASE WHEN m IS NULL OR ts > m THEN ts END) OVER (PARTITION BY seqid ORDER BY ts, te, tid ROWS UNBOUNDED PRECEDING) AS b FROM l),
c AS (SELECT *, count(*) OVER (PARTITION BY seqid, b) AS n FROM r)
SELECT tid, seqid, strand, gene, b AS bundle FROM c WHERE n = 1""")
def pair_singletons(spark, sf):
    return pairs.singletons(stored_transcripts(spark, sf)).select("tid", *AXIS, "gene", "bundle")


_DIFF = f"""WITH {S.TX}, {S.classes('ct', 'seqid, strand, is_template')},
pp AS (SELECT a.tid AS tid1, b.tid AS tid2, a.strand, a.clen AS c1, b.clen AS c2, a.ts AS ts1, b.ts AS ts2, a.te AS te1, b.te AS te2
 FROM ct a JOIN ct b ON a.seqid=b.seqid AND a.strand=b.strand AND NOT a.is_template AND b.is_template AND a.ts<=b.te AND b.ts<=a.te),
cut AS (SELECT tid1, tid2, s AS p FROM pp JOIN exon x ON x.tid=tid1 UNION SELECT tid1, tid2, e+1 FROM pp JOIN exon x ON x.tid=tid1
 UNION SELECT tid1, tid2, s FROM pp JOIN exon x ON x.tid=tid2 UNION SELECT tid1, tid2, e+1 FROM pp JOIN exon x ON x.tid=tid2),
cell AS (SELECT tid1, tid2, p AS s, lead(p) OVER (PARTITION BY tid1, tid2 ORDER BY p)-1 AS e FROM cut),
ina AS (SELECT c.tid1, c.tid2, c.s FROM cell c JOIN exon x ON x.tid=c.tid1 AND x.s<=c.s AND x.e>=c.e),
inb AS (SELECT c.tid1, c.tid2, c.s FROM cell c JOIN exon x ON x.tid=c.tid2 AND x.s<=c.s AND x.e>=c.e),
coded AS (SELECT c.tid1, c.tid2, c.s, c.e, c.e-c.s+1 AS n, (a.s IS NOT NULL) AS fa, (b.s IS NOT NULL) AS fb
 FROM cell c LEFT JOIN ina a USING (tid1,tid2,s) LEFT JOIN inb b USING (tid1,tid2,s) WHERE c.e IS NOT NULL AND (a.s IS NOT NULL OR b.s IS NOT NULL)),
ord AS (SELECT *, CASE WHEN strand='-' THEN -s ELSE s END AS o FROM coded JOIN pp USING (tid1,tid2)),
fr AS (SELECT *, coalesce(sum(CASE WHEN fa AND NOT fb THEN n ELSE 0 END) OVER w, 0) AS q, coalesce(sum(CASE WHEN fb AND NOT fa THEN n ELSE 0 END) OVER w, 0) AS t
 FROM ord WINDOW w AS (PARTITION BY tid1, tid2 ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
agg AS (SELECT tid1, tid2, any_value(strand) AS strand, any_value(c1) AS c1, any_value(c2) AS c2, any_value(ts1) AS ts1, any_value(ts2) AS ts2, any_value(te1) AS te1, any_value(te2) AS te2,
 CAST(sum(CASE WHEN fa AND NOT fb THEN n ELSE 0 END) AS BIGINT) AS extra, CAST(sum(CASE WHEN fb AND NOT fa THEN n ELSE 0 END) AS BIGINT) AS missing,
 CAST(sum(CASE WHEN fa AND fb THEN n ELSE 0 END) AS BIGINT) AS matched, CAST(sum(CASE WHEN fa AND fb AND q%3=t%3 THEN n ELSE 0 END) AS BIGINT) AS inframe,
 CAST(sum(n) AS BIGINT) AS u FROM fr GROUP BY tid1, tid2)
SELECT tid1, tid2, c1 AS c1len, c2 AS c2len,
 CAST(CASE WHEN strand='-' THEN te1=te2 ELSE ts1=ts2 END AS BIGINT) AS match_start, CAST(CASE WHEN strand='-' THEN ts1=ts2 ELSE te1=te2 END AS BIGINT) AS match_end,
 extra, missing, inframe, matched, matched-inframe AS outframe, c1*100//u AS lpi, inframe*100//u AS ilpi, matched*100//u AS mlpi FROM agg"""


@query("chain_diff_metrics", _DIFF)
def chain_diff_metrics(spark, sf):
    cls = pairs.chain_classes(stored_transcripts(spark, sf), [*AXIS, "is_template"])
    cols = [*AXIS, "tid", "start", "end", "chain"]
    p = overlap_join(cls.where(~F.col("is_template")).select(*cols), cls.where("is_template").select(*cols), AXIS)
    m = C.compare_metrics(F.col("l_chain"), F.col("r_chain"), F.col("strand"))
    return p.select(F.col("l_tid").alias("tid1"), F.col("r_tid").alias("tid2"), m.alias("m")).select("tid1", "tid2", "m.*")


# ---------------------------------------------------------------- labels and decisions

@query("label_groups", f"""WITH {S.TX}, c AS (SELECT tx.*, ic FROM tx LEFT JOIN ichain USING (tid)),
m AS (SELECT min(tid) FILTER (WHERE NOT is_template) AS q, min(tid) FILTER (WHERE is_template) AS t,
  count(*) FILTER (WHERE NOT is_template) AS nq, count(*) FILTER (WHERE is_template) AS nt FROM c WHERE ic IS NOT NULL GROUP BY seqid, strand, ic),
o AS (SELECT seqid, strand, is_template, ts, te, min(tid) AS tid, count(*) AS n FROM c WHERE ic IS NULL GROUP BY ALL)
SELECT CAST(1 AS INT) AS status, q AS query_tid, t AS template_tid, nq AS n_queries, nt AS n_templates FROM m WHERE nq>0 AND nt>0
UNION ALL SELECT 4, a.tid, b.tid, a.n, b.n FROM o a JOIN o b ON a.seqid=b.seqid AND a.strand=b.strand AND NOT a.is_template AND b.is_template
 AND a.ts<=b.te AND b.ts<=a.te AND ((least(a.te,b.te)-greatest(a.ts,b.ts)+1)*100//(a.te-a.ts+1) >= 100 OR (least(a.te,b.te)-greatest(a.ts,b.ts)+1)*100//(b.te-b.ts+1) >= 100)""")
def label_groups(spark, sf):
    return labels.match_groups(stored_transcripts(spark, sf)).withColumn("status", F.col("status").cast("int"))


@query("label_matches", f"""WITH {S.TX}, c AS (SELECT tx.*, ic FROM tx LEFT JOIN ichain USING (tid))
SELECT a.tid, count(*) AS n_templates, min(b.tid) AS first_template FROM c a JOIN c b ON a.seqid=b.seqid AND a.strand=b.strand
 AND NOT a.is_template AND b.is_template AND (a.ic=b.ic OR (a.nx=1 AND b.nx=1 AND a.ts<=b.te AND b.ts<=a.te AND
 ((least(a.te,b.te)-greatest(a.ts,b.ts)+1)*100//(a.te-a.ts+1) >= 100 OR (least(a.te,b.te)-greatest(a.ts,b.ts)+1)*100//(b.te-b.ts+1) >= 100)))
GROUP BY a.tid""")
def label_matches(spark, sf):
    return labels.label_matches(stored_transcripts(spark, sf))


@query("template_presence", f"""WITH {S.TX}, c AS (SELECT tx.*, ic FROM tx LEFT JOIN ichain USING (tid)),
q AS (SELECT * FROM c WHERE NOT is_template), t AS (SELECT * FROM c WHERE is_template),
cand AS (
 SELECT t.tid, q.ts, q.te, q.tid AS q, q.strand AS qs, 'nn' AS ty FROM t JOIN q ON t.seqid=q.seqid AND t.strand=q.strand AND t.ic=q.ic
 UNION ALL SELECT t.tid, q.ts, q.te, q.tid, q.strand, '11' FROM t JOIN q ON t.seqid=q.seqid AND t.nx=1 AND q.nx=1 AND q.ts<=t.te AND t.ts<=q.te
   AND (least(t.te,q.te)-greatest(t.ts,q.ts)+1)*100//(t.te-t.ts+1) >= 100
 UNION ALL SELECT t.tid, q.ts, q.te, q.tid, q.strand, '1n' FROM t JOIN exon x ON t.seqid=x.seqid AND t.strand=x.strand AND t.nx=1 AND NOT x.is_template AND x.s<=t.ts AND x.e>=t.te
   JOIN q ON q.tid=x.tid AND q.nx>1),
best AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY ts, te, q) AS k FROM cand),
hit AS (SELECT b.*, CASE WHEN ty='1n' THEN row_number() OVER (PARTITION BY b.q, ty ORDER BY t.ts, t.te, t.tid) - 1 ELSE 0 END AS rep FROM best b JOIN t ON t.tid=b.tid WHERE k=1)
SELECT t.tid, CAST(h.tid IS NOT NULL AS INT) AS matched, coalesce(h.ty, CASE WHEN t.nx>1 THEN 'n' ELSE '1' END) AS type, h.q AS query_tid,
 coalesce(h.rep, 0) AS repeat, CASE WHEN h.tid IS NOT NULL THEN CAST(t.strand<>h.qs AS INT) END AS strand_differs
FROM t LEFT JOIN hit h ON h.tid=t.tid""")
def template_presence(spark, sf):
    return labels.template_presence(stored_transcripts(spark, sf))


_COMP = f"""tt AS (SELECT * FROM tx WHERE is_template),
ed AS (SELECT a.tid AS a, b.tid AS b FROM tt a JOIN tt b ON a.seqid=b.seqid AND a.strand=b.strand AND a.ts<=b.te AND b.ts<=a.te WHERE
  (a.ts<=b.ts AND a.te>=b.te) OR (b.ts<=a.ts AND b.te>=a.te)
  OR EXISTS (SELECT 1 FROM exon x JOIN exon y ON x.s<=y.e AND y.s<=x.e WHERE x.tid=a.tid AND y.tid=b.tid)),
reach AS (SELECT a AS tid, a AS node FROM ed WHERE a=b UNION SELECT r.tid, ed.b FROM reach r JOIN ed ON ed.a=r.node),
comp AS (SELECT tid, min(node) AS component FROM reach GROUP BY tid)"""


@query("template_components", f"WITH RECURSIVE {S.TX}, {_COMP} SELECT tid, component FROM comp")
def template_components(spark, sf):
    return pairs.span_components(stored_transcripts(spark, sf).where("is_template"))


@query("readthrough_status", f"""WITH RECURSIVE {S.TX}, {_COMP}, {S.QT_PAIRS},
h AS (SELECT tid1, min(component) AS lo, max(component) AS hi FROM qt JOIN comp ON comp.tid=qt.tid2 WHERE status<>0 AND NOT (nx1>1 AND status=6) GROUP BY tid1)
SELECT q.tid, CASE WHEN lo IS NULL THEN 'unknown' WHEN lo=hi THEN 'pass' ELSE 'fail' END AS reader_status
FROM tx q JOIN ct ON ct.seqid=q.seqid AND ct.strand=q.strand AND ct.chain=q.chain AND NOT ct.is_template LEFT JOIN h ON h.tid1=ct.tid WHERE NOT q.is_template""")
def readthrough_status(spark, sf):
    return pairs.readthrough(stored_transcripts(spark, sf))


def _ends_sql(threshold: int, extend: int) -> str:
    def tier(rank: int, cond: str) -> str:
        return f"SELECT q.tid, q.ts, q.te, q.e1, q.sn, t.tid AS src, t.ts AS a, t.te AS b, {rank} AS tier FROM q JOIN t ON q.seqid=t.seqid AND q.strand=t.strand AND {cond}"

    lim_a = f"(tier<3 OR (abs(a-ts)<={threshold} AND (a>=ts OR ts-a<={extend})))"
    lim_b = f"(tier<3 OR (abs(b-te)<={threshold} AND (b<=te OR b-te<={extend})))"
    return f"""WITH {S.BUNDLE}, c AS (SELECT b.*, ic, i1, im FROM bundle b LEFT JOIN ichain USING (tid)),
q AS (SELECT * FROM c WHERE NOT is_template AND nx>1), t AS (SELECT * FROM c WHERE is_template),
sc AS ({tier(0, 'q.ic=t.ic')} UNION ALL {tier(1, 'q.i1=t.i1 AND q.im=t.im')} UNION ALL {tier(2, 'q.i1=t.i1')} UNION ALL {tier(3, 'q.bundle=t.bundle')}),
ec AS ({tier(0, 'q.ic=t.ic')} UNION ALL {tier(1, 'q.i1=t.i1 AND q.im=t.im')} UNION ALL {tier(2, 'q.im=t.im')} UNION ALL {tier(3, 'q.bundle=t.bundle')}),
st AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY tier, abs(a-ts), src) AS k FROM sc WHERE a<=e1 AND {lim_a}),
en AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY tier, abs(b-te), src) AS k FROM ec WHERE b>=sn AND {lim_b})
SELECT c.tid, coalesce(st.a, c.ts) AS new_start, st.src AS start_source, coalesce(en.b, c.te) AS new_end, en.src AS end_source,
 CAST(CASE WHEN st.src IS NOT NULL AND en.src IS NOT NULL THEN 0 WHEN st.src IS NOT NULL THEN 2 WHEN en.src IS NOT NULL THEN 3 ELSE -1 END AS INT) AS status
FROM c LEFT JOIN st ON st.tid=c.tid AND st.k=1 LEFT JOIN en ON en.tid=c.tid AND en.k=1 WHERE NOT c.is_template"""


@query("end_correction", _ends_sql(40, 20))
def end_correction(spark, sf):
    return labels.correct_ends(stored_transcripts(spark, sf), threshold=40, max_extend=20)


_BEST = f"""{S.QT_PAIRS},
bt AS (SELECT *, row_number() OVER (PARTITION BY tid1 ORDER BY status, bp DESC, tid2) AS k FROM qt WHERE status<>0 AND NOT (nx1>1 AND status=6)),
qm AS (SELECT q.*, ct.tid AS class_tid FROM tx q JOIN ct ON ct.seqid=q.seqid AND ct.strand=q.strand AND ct.chain=q.chain AND NOT ct.is_template WHERE NOT q.is_template)"""


@query("best_template", f"WITH {S.TX}, {_BEST} SELECT tid1 AS class_tid, tid2 AS template, CAST(status AS INT) AS status, bp AS bases FROM bt WHERE k=1")
def best_template(spark, sf):
    return labels.best_template(stored_transcripts(spark, sf)).select("class_tid", "template", "status", "bases")


@query("assigned_ids", f"""WITH RECURSIVE {S.TX}, {_BEST},
p AS (SELECT q.tid, q.seqid, q.strand, q.ts, q.te, b.tid2, b.status, (b.tid2//40)*10+b.tid2%10 AS gid, (b.tid2%40)//10 AS num,
  CASE WHEN b.tid2 IS NULL THEN 'novel' WHEN b.status=1 OR (b.status=4 AND (b.bp*100//b.clen1>=100 OR b.bp*100//b.clen2>=100)) THEN 'same' ELSE 'next' END AS kind
 FROM qm q LEFT JOIN bt b ON b.tid1=q.class_tid AND b.k=1),
top AS (SELECT (tid//40)*10+tid%10 AS gid, max((tid%40)//10) AS top FROM tx WHERE is_template GROUP BY 1),
nv AS (SELECT t.* FROM tx t JOIN p ON p.tid=t.tid AND p.kind='novel'),
ed AS (SELECT a.tid AS a, b.tid AS b FROM nv a JOIN nv b ON a.seqid=b.seqid AND a.strand=b.strand AND a.ts<=b.te AND b.ts<=a.te WHERE
  (a.ts<=b.ts AND a.te>=b.te) OR (b.ts<=a.ts AND b.te>=a.te) OR EXISTS (SELECT 1 FROM exon x JOIN exon y ON x.s<=y.e AND y.s<=x.e WHERE x.tid=a.tid AND y.tid=b.tid)),
reach AS (SELECT a AS tid, a AS node FROM ed WHERE a=b UNION SELECT r.tid, ed.b FROM reach r JOIN ed ON ed.a=r.node),
comp AS (SELECT tid, min(node) AS component FROM reach GROUP BY tid),
cs AS (SELECT seqid, strand, component, min(ts) AS cts FROM comp JOIN nv USING (tid) GROUP BY 1,2,3),
cr AS (SELECT *, row_number() OVER (ORDER BY seqid, strand, cts, component) AS r FROM cs)
SELECT tid, gid, num, kind, CAST(row_number() OVER (PARTITION BY gid, num ORDER BY ts, te, tid) > 1 AS INT) AS duplicate FROM p WHERE kind='same'
UNION ALL SELECT p.tid, p.gid, top + row_number() OVER (PARTITION BY p.gid ORDER BY ts, te, tid), kind, 0 FROM p JOIN top USING (gid) WHERE kind='next'
UNION ALL SELECT nv.tid, (SELECT max(gid) FROM top) + r, row_number() OVER (PARTITION BY component ORDER BY nv.ts, nv.te, nv.tid) - 1, 'novel', 0
 FROM nv JOIN comp USING (tid) JOIN cr USING (component)""")
def assigned_ids(spark, sf):
    out = genes.assign_ids(numbered_ids(stored_transcripts(spark, sf)))
    return out.select("tid", F.col("gid").cast("bigint").alias("gid"), F.col("num").cast("bigint").alias("num"), "kind", "duplicate")


@query("split_loci", f"""WITH {S.TX}, g AS (SELECT *, (tid//40)*10+tid%10 AS gid FROM tx),
l AS (SELECT *, max(te) OVER (PARTITION BY gid, seqid, strand ORDER BY ts, te, tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM g),
r AS (SELECT *, max(CASE WHEN m IS NULL OR ts>m THEN ts END) OVER (PARTITION BY gid, seqid, strand ORDER BY ts, te, tid ROWS UNBOUNDED PRECEDING) AS part FROM l),
d AS (SELECT DISTINCT gid, part FROM r), f AS (SELECT *, min(part) OVER (PARTITION BY gid) AS p0 FROM d),
n AS (SELECT gid, part, (SELECT max(gid) FROM g) + row_number() OVER (ORDER BY gid, part) AS new_gid FROM f WHERE part>p0)
SELECT tid, gid, coalesce(n.new_gid, gid) AS new_gid FROM r LEFT JOIN n USING (gid, part)""")
def split_loci(spark, sf):
    return genes.split_loci(numbered_ids(stored_transcripts(spark, sf)))


# ---------------------------------------------------------------- genes

@query("gene_spans", f"""WITH {S.TX} SELECT gene, min(seqid) AS seqid, min(ts) AS "start", max(te) AS "end",
 CASE WHEN min(strand)=max(strand) THEN min(strand) ELSE '.' END AS strand, count(*) AS n_tx FROM tx GROUP BY gene""")
def gene_spans(spark, sf):
    return genes.gene_rows(transcripts(spark, sf))


@query("gene_bed", f"""WITH {S.TX} SELECT min(seqid) AS seqid, greatest(min(ts)-1, 1) AS "start", max(te)+1 AS "end", gene, '.' AS score, min(strand) AS strand FROM tx GROUP BY gene""")
def gene_bed(spark, sf):
    return genes.gene_bed(transcripts(spark, sf))


@query("tx_per_gene", f"WITH {S.TX} SELECT gene, count(*) AS n_tx FROM tx GROUP BY gene")
def tx_per_gene(spark, sf):
    return genes.transcripts_per_gene(transcripts(spark, sf))


@query("exons_per_tx", f"WITH {S.EXON} SELECT tid, count(*) AS n_exons FROM exon GROUP BY tid")
def exons_per_tx(spark, sf):
    return genes.exons_per_transcript(exons(spark, sf))


@query("coding_genes", f"WITH {S.TX}, {S.CDS} SELECT DISTINCT gene FROM cds")
def coding_genes(spark, sf):
    return genes.coding_genes(coding(transcripts(spark, sf)))


@query("coding_stats", f"""WITH {S.TX}, {S.CDS}, cc AS (SELECT gene, tid, string_agg(s||'-'||e, ',' ORDER BY s) AS c FROM cds GROUP BY 1,2),
a AS (SELECT gene, count(*) AS n FROM tx WHERE gene IN (SELECT gene FROM cds) GROUP BY gene), b AS (SELECT gene, count(DISTINCT c) AS n FROM cc GROUP BY gene)
SELECT 'transcripts per coding gene' AS stat, avg(n) AS value FROM a UNION ALL SELECT 'distinct coding chains per gene', avg(n) FROM b""")
def coding_stats(spark, sf):
    return genes.coding_stats(coding(stored_transcripts(spark, sf)))


@query("adjacent_overlap_genes", f"""WITH {S.TX}, {S.CDS}, g AS (SELECT seqid, strand, gene, min(s) AS s, max(e) AS e FROM cds GROUP BY 1,2,3),
l AS (SELECT *, lead(s) OVER w AS ns, lead(gene) OVER w AS ng FROM g WINDOW w AS (PARTITION BY seqid, strand ORDER BY s, e, gene))
SELECT gene FROM l WHERE e>ns UNION SELECT ng FROM l WHERE e>ns""")
def adjacent_overlap_genes(spark, sf):
    return genes.adjacent_overlaps(coding(stored_transcripts(spark, sf)))


@query("clean_genes", f"""WITH {S.TX}, {S.CDS}, g AS (SELECT seqid, strand, gene, min(s) AS s, max(e) AS e FROM cds GROUP BY 1,2,3),
l AS (SELECT *, lead(s) OVER w AS ns, lead(gene) OVER w AS ng FROM g WINDOW w AS (PARTITION BY seqid, strand ORDER BY s, e, gene)),
bad AS (SELECT gene FROM l WHERE e>ns UNION SELECT ng FROM l WHERE e>ns UNION SELECT gene FROM tx GROUP BY gene HAVING max(nx)=1)
SELECT tid, gene FROM tx WHERE gene NOT IN (SELECT gene FROM bad)""")
def clean_genes(spark, sf):
    return genes.gene_filter(coding(stored_transcripts(spark, sf))).select("tid", "gene")


@query("dedupe_chains", f"""WITH {S.TX}, s AS (SELECT *, tid%7 AS ilpi, tid%11 AS mom FROM tx),
g AS (SELECT *, max(ilpi) OVER w AS im, max(mom) OVER w AS mm, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY gene, seqid, strand, chain)),
k AS (SELECT *, row_number() OVER (PARTITION BY gene, seqid, strand, chain ORDER BY CASE WHEN im>0 THEN -ilpi WHEN mm>0 THEN -mom ELSE 0 END, tid) AS rn FROM g)
SELECT tid, n AS n_copies FROM k WHERE rn=1""")
def dedupe_chains(spark, sf):
    tx = stored_transcripts(spark, sf).withColumn("ilpi", F.col("tid") % 7).withColumn("mom", F.col("tid") % 11)
    return genes.deduplicate(tx).select("tid", "n_copies")


# ---------------------------------------------------------------- sets and splicing

SOURCES = ["a", "b", "c"]


def _source() -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in SOURCES]), (F.col("tid") % 3 + 1).cast("int"))


@query("venn3_bp", f"""WITH {S.EXON}, lab AS (SELECT *, tid%3 AS src FROM exon),
pos AS (SELECT seqid, src, unnest(range(s, e+1)) AS p FROM lab), m AS (SELECT seqid, p, bit_or(CAST(1 << src AS BIGINT)) AS mask FROM pos GROUP BY 1,2)
SELECT seqid, mask, count(*) AS bases FROM m GROUP BY 1,2""")
def venn3_bp(spark, sf):
    # the bases of a source do not depend on whether exons are merged in their transcripts first
    ex = raw_exons(spark, sf).select(*axis_columns(), "tid", "s", "e").select("seqid", "s", "e", _source().alias("src"))
    return sets.venn_bases(ex, ["seqid"], "src", SOURCES)


_ITEMS = f"""WITH {S.TX}, it AS (SELECT 'exon' AS kind, seqid||strand||s||'-'||e AS item, tid%3 AS src FROM exon
 UNION ALL SELECT 'intron', seqid||strand||s||'-'||e, tid%3 FROM intr),
names AS (SELECT * FROM (VALUES (1,'a'),(2,'b'),(4,'c'),(3,'a,b'),(5,'a,c'),(6,'b,c'),(7,'a,b,c')) v(mask, label_set))"""


@query("exclusive_sets", f"""{_ITEMS}, m AS (SELECT kind, item, bit_or(1 << src) AS mask FROM it GROUP BY 1,2), c AS (SELECT mask, count(*) AS n FROM m WHERE kind='intron' GROUP BY 1)
SELECT label_set, coalesce(n, 0) AS n FROM names LEFT JOIN c USING (mask)""")
def exclusive_sets(spark, sf):
    items = sets.exon_intron_items(stored_transcripts(spark, sf).withColumn("label", _source())).where("kind = 'intron'")
    return sets.exclusive_sets(items, ["item"], "label", SOURCES)


@query("exclusive_sets_exons", f"""{_ITEMS}, m AS (SELECT kind, item, bit_or(1 << src) AS mask FROM it GROUP BY 1,2), c AS (SELECT mask, count(*) AS n FROM m WHERE kind='exon' GROUP BY 1)
SELECT label_set, coalesce(n, 0) AS n FROM names LEFT JOIN c USING (mask)""")
def exclusive_sets_exons(spark, sf):
    items = sets.exon_intron_items(transcripts(spark, sf).withColumn("label", _source())).where("kind = 'exon'")
    return sets.exclusive_sets(items, ["item"], "label", SOURCES)


@query("id_map_outer", f"""WITH {S.TX}, i AS (SELECT seqid, strand, ic, tid%3 AS src, min(tid) AS tid FROM ichain GROUP BY 1,2,3,4)
SELECT min(tid) FILTER (WHERE src=0) AS id_a, min(tid) FILTER (WHERE src=1) AS id_b, min(tid) FILTER (WHERE src=2) AS id_c FROM i GROUP BY seqid, strand, ic""")
def id_map_outer(spark, sf):
    tx = stored_transcripts(spark, sf).where(F.size("chain") > 1).select(
        "tid", *AXIS, C.introns(F.col("chain")).alias("ic"), _source().alias("label")
    )
    return sets.id_map(tx, [*AXIS, "ic"], "label", SOURCES).select("id_a", "id_b", "id_c")


def _block(label3: tuple[str, str, str], t: str, q: str) -> str:
    return f"""SELECT '{label3[0]}' AS label, count(*) AS count FROM (SELECT DISTINCT seqid, strand, s, e FROM {t} WHERE is_template)
UNION ALL SELECT '{label3[1]}', count(*) FROM (SELECT DISTINCT seqid, strand, s, e FROM {t} WHERE is_template) a
 WHERE EXISTS (SELECT 1 FROM {q} b WHERE NOT b.is_template AND a.seqid=b.seqid AND a.strand=b.strand AND b.s<=a.s AND b.e>=a.e)
UNION ALL SELECT '{label3[2]}', count(DISTINCT tid) FROM {q} b WHERE NOT b.is_template
 AND EXISTS (SELECT 1 FROM {t} a WHERE a.is_template AND a.seqid=b.seqid AND a.strand=b.strand AND b.s<=a.s AND b.e>=a.e)"""


@query("splicing_changes", f"""WITH {S.TX}, {S.CDS}, gap AS (SELECT tid, seqid, strand, is_template, s+1 AS s, e-1 AS e FROM intr),
cg0 AS (SELECT tid, seqid, strand, is_template, e+1 AS s, lead(s) OVER (PARTITION BY tid ORDER BY s)-1 AS e FROM cds), cgap AS (SELECT * FROM cg0 WHERE e IS NOT NULL),
cpos AS (SELECT tid, seqid, strand, is_template, unnest(range(s, e+1)) AS p FROM cds),
rk AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY p) AS lo, row_number() OVER (PARTITION BY tid ORDER BY p DESC) AS hi FROM cpos),
cod AS (SELECT tid, seqid, is_template, strand, string_agg(p, ',' ORDER BY p) FILTER (WHERE lo<=3) AS f, string_agg(p, ',' ORDER BY p DESC) FILTER (WHERE hi<=3) AS r FROM rk GROUP BY 1,2,3,4 HAVING count(*)>=3),
se AS (SELECT seqid, strand, is_template, CASE WHEN strand='-' THEN r ELSE f END AS st, CASE WHEN strand='-' THEN f ELSE r END AS en FROM cod)
SELECT 'Alternative Starts' AS label, count(*) AS count FROM (SELECT seqid, strand, st FROM se WHERE NOT is_template EXCEPT SELECT seqid, strand, st FROM se WHERE is_template)
UNION ALL SELECT 'Alternative Ends', count(*) FROM (SELECT seqid, strand, en FROM se WHERE NOT is_template EXCEPT SELECT seqid, strand, en FROM se WHERE is_template)
UNION ALL {_block(("Total number of Exons in Template", "Template Exons Skipped", "Query Transcripts Skipping tmpl Exons"), "exon", "gap")}
UNION ALL {_block(("Total number of Coding Exons in Template", "Template Coding Exons Skipped", "Query Transcripts Skipping tmpl Coding Exons"), "cds", "gap")}
UNION ALL {_block(("Total number of introns in Template", "Template Introns Retained", "Query Transcripts Retaining tmpl Introns"), "gap", "exon")}
UNION ALL {_block(("Total number of Coding Introns in Template", "Template Coding Introns Retained", "Query Transcripts Retaining tmpl Coding Introns"), "cgap", "exon")}""")
def splicing_changes(spark, sf):
    tx = coding(stored_transcripts(spark, sf))
    return splicing.splicing_changes(tx.where(~F.col("is_template")), tx.where("is_template"))


# ---------------------------------------------------------------- explanation curves

def _curve_inputs(spark, sf):
    tx = transcripts(spark, sf).where(F.size("chain") > 1)
    members = stored(splicing.explode_chain(tx, C.introns(F.col("chain")), ["gene", "tid", *AXIS]))
    introns = members.select("gene", *AXIS, "s", "e").distinct().select(
        "*", ((F.col("s") * 7 + F.col("e")) % 101 + 1).alias("cov"), ((F.col("s") + F.col("e")) % 4 - 1).alias("kind")
    )
    expression = members.select("gene", "tid", (F.col("tid") % 97 + 1).alias("tpm")).distinct()
    return introns, members, expression


_CURVE = f"""WITH {S.TX}, mem AS (SELECT gene, tid, seqid, strand, s, e FROM intr),
gi AS (SELECT DISTINCT gene, seqid, strand, s, e, (s*7+e)%101+1 AS cov, (s+e)%4-1 AS kind FROM mem),
rk AS (SELECT *, row_number() OVER w AS rank, sum(cov) OVER (w ROWS UNBOUNDED PRECEDING) AS cum, sum(cov) OVER (PARTITION BY gene) AS total, count(*) OVER (PARTITION BY gene) AS n
 FROM gi WHERE kind<>-1 WINDOW w AS (PARTITION BY gene ORDER BY cov DESC, s, e, seqid, strand)),
ex AS (SELECT DISTINCT gene, tid, tid%97+1 AS tpm FROM mem), tot AS (SELECT gene, sum(tpm) AS total FROM ex GROUP BY gene),
ps AS (SELECT m.gene, m.tid, max(rank) AS pos FROM mem m LEFT JOIN rk USING (gene, seqid, strand, s, e) GROUP BY 1,2 HAVING count(*) = count(rank)),
pt AS (SELECT gene, tid, pos, tpm FROM ps JOIN ex USING (gene, tid)),
wt AS (SELECT *, max(pos) OVER (PARTITION BY gene ORDER BY tpm DESC, tid ROWS UNBOUNDED PRECEDING) AS wait FROM pt),
fi AS (SELECT gene, seqid, strand, s, e, tid, row_number() OVER (PARTITION BY gene, seqid, strand, s, e ORDER BY wait, tpm DESC, tid) AS k
 FROM mem JOIN gi USING (gene, seqid, strand, s, e) JOIN wt USING (gene, tid) WHERE kind=1)"""


@query("explanation_curve", f"""{_CURVE} SELECT gene, seqid, strand, s, e, cov, rank, CAST(rank*100 AS DOUBLE)/n AS introns_pct, CAST(cov*100 AS DOUBLE)/CAST(total AS DOUBLE) AS cov_pct, CAST(cum*100 AS DOUBLE)/CAST(total AS DOUBLE) AS cum_cov_pct FROM rk""")
def explanation_curve(spark, sf):
    return curves.explanation_curve(_curve_inputs(spark, sf)[0])


@query("tx_completion", f"""{_CURVE} SELECT gene, tid, pos, CAST(tpm*100 AS DOUBLE)/CAST(total AS DOUBLE) AS tpm_pct,
 CAST(sum(tpm) OVER (PARTITION BY gene ORDER BY pos, tid ROWS UNBOUNDED PRECEDING)*100 AS DOUBLE)/CAST(total AS DOUBLE) AS cum_tpm_pct FROM pt JOIN tot USING (gene)""")
def tx_completion(spark, sf):
    return curves.completion(*_curve_inputs(spark, sf))


@query("tx_completion_ordered", f"""{_CURVE} SELECT gene, tid, wait AS pos,
 CAST(sum(tpm) OVER (PARTITION BY gene ORDER BY wait, tpm DESC, tid ROWS UNBOUNDED PRECEDING)*100 AS DOUBLE)/CAST(total AS DOUBLE) AS cum_tpm_pct,
 CAST(EXISTS (SELECT 1 FROM fi WHERE fi.tid=wt.tid AND fi.k=1) AS INT) AS is_unique FROM wt JOIN tot USING (gene)""")
def tx_completion_ordered(spark, sf):
    return curves.completion_ordered(*_curve_inputs(spark, sf))


_GOOD = f"""WITH {S.TX}, good AS (SELECT DISTINCT seqid, strand, s, e FROM intr WHERE (s+e)%3=0)"""


def _good(members: DataFrame) -> DataFrame:
    return members.where((F.col("s") + F.col("e")) % 3 == 0)


@query("select_any", f"{_GOOD} SELECT DISTINCT tid FROM intr JOIN good USING (seqid, strand, s, e)")
def select_any(spark, sf):
    members = _curve_inputs(spark, sf)[1]
    return curves.select_any(members, _good(members))


@query("select_all_good", f"{_GOOD} SELECT tid FROM intr LEFT JOIN good g USING (seqid, strand, s, e) GROUP BY tid HAVING count(*) = count(*) FILTER (WHERE (intr.s+intr.e)%3=0)")
def select_all_good(spark, sf):
    members = _curve_inputs(spark, sf)[1]
    return curves.select_all_good(members, _good(members))


@query("greedy_min_cover", f"""{_GOOD}, r AS (SELECT tid, row_number() OVER (PARTITION BY seqid, strand, s, e ORDER BY gene, tid%97+1 DESC, tid) AS k FROM intr JOIN good USING (seqid, strand, s, e))
SELECT DISTINCT tid FROM r WHERE k=1""")
def greedy_min_cover(spark, sf):
    _, members, expression = _curve_inputs(spark, sf)
    return curves.greedy_min_cover(members, _good(members), expression)
