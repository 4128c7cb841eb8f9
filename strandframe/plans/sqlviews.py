"""The derived interval views of :mod:`.views` as plain SQL, for result checks."""

AXIS = """'s'||(tid%5) AS seqid, CASE WHEN (tid//5)%2=0 THEN '+' ELSE '-' END AS strand,
  (tid//10)%2=0 AS is_template, (tid%10)||'g'||(tid//40) AS gene"""

RAW = """raw AS (
 SELECT l_orderkey AS tid, (l_orderkey//40)*200 + ((l_orderkey//40)*7919)%97 + (l_partkey%12)*15 AS s,
  (l_orderkey//40)*200 + ((l_orderkey//40)*7919)%97 + (l_partkey%12)*15 + 5 + (CAST(floor(l_quantity) AS BIGINT)%2)*4 AS e
 FROM lineitem)"""


def merged(name: str, source: str, keys: str, gap: int = 0) -> str:
    return f"""{name}_l AS (
 SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
 FROM (SELECT DISTINCT {keys}, s, e FROM {source})),
{name}_r AS (
 SELECT *, sum(CASE WHEN m IS NULL OR s > m + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS r
 FROM {name}_l),
{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM {name}_r GROUP BY {keys}, r)"""


EXON = RAW + ",\n" + merged("mex", "raw", "tid") + f""",
exon AS (SELECT tid, s, e, {AXIS} FROM mex)"""

TX = EXON + """,
tx AS (SELECT tid, seqid, strand, is_template, gene, min(s) AS ts, max(e) AS te, count(*) AS nx,
  CAST(sum(e-s+1) AS BIGINT) AS clen, string_agg(s||'-'||e, ',' ORDER BY s) AS chain, min(e) AS e1, max(s) AS sn
 FROM exon GROUP BY tid, seqid, strand, is_template, gene),
intr0 AS (SELECT tid, seqid, strand, is_template, gene, e AS s, lead(s) OVER (PARTITION BY tid ORDER BY s) AS e FROM exon),
intr AS (SELECT * FROM intr0 WHERE e IS NOT NULL),
ichain AS (SELECT tid, seqid, strand, is_template, gene, string_agg(s||'-'||e, ',' ORDER BY s) AS ic,
  min(s||'-'||e) FILTER (WHERE k = 1) AS i1, min(s||'-'||e) FILTER (WHERE k = n) AS im
 FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY s) AS k, count(*) OVER (PARTITION BY tid) AS n FROM intr)
 GROUP BY tid, seqid, strand, is_template, gene)"""

BUNDLE = TX + """,
bl AS (SELECT *, max(te) OVER (PARTITION BY seqid, strand ORDER BY ts, te, tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM tx),
br AS (SELECT *, max(CASE WHEN m IS NULL OR ts > m THEN ts END) OVER (PARTITION BY seqid, strand ORDER BY ts, te, tid ROWS UNBOUNDED PRECEDING) AS bundle FROM bl),
bundle AS (SELECT * FROM br)"""

CDS = """cds AS (SELECT x.tid, x.seqid, x.strand, x.is_template, x.gene, greatest(x.s, t.ts+2) AS s, least(x.e, t.te-2) AS e
 FROM exon x JOIN tx t USING (tid) WHERE x.tid%3<>0 AND greatest(x.s, t.ts+2) <= least(x.e, t.te-2))"""


def classes(name: str = "cls", by: str = "seqid, strand") -> str:
    return f"""{name} AS (SELECT {by}, chain, min(tid) AS tid, count(*) AS n, min(ts) AS ts, min(te) AS te, min(nx) AS nx, min(clen) AS clen
 FROM tx GROUP BY {by}, chain)"""


def relations(name: str, pairs: str) -> str:
    """``pairs`` has tid1, tid2 and the spans ts1, te1, ts2, te2, exon counts nx1, nx2."""
    return f"""{name}_b AS (SELECT p.tid1, p.tid2, CAST(sum(least(a.e,b.e)-greatest(a.s,b.s)+1) AS BIGINT) AS bp
  FROM {pairs} p JOIN exon a ON a.tid=p.tid1 JOIN exon b ON b.tid=p.tid2 WHERE a.s<=b.e AND b.s<=a.e GROUP BY 1,2),
{name}_i AS (SELECT p.tid1, p.tid2, count(*) AS sh FROM {pairs} p JOIN intr a ON a.tid=p.tid1 JOIN intr b ON b.tid=p.tid2 AND a.s=b.s AND a.e=b.e GROUP BY 1,2),
{name}_x AS (SELECT p.tid1, p.tid2, count(*) AS c FROM {pairs} p JOIN exon a ON a.tid=p.tid1 WHERE a.s<=p.te2 AND a.e>=p.ts2 GROUP BY 1,2),
{name}_y AS (SELECT p.tid1, p.tid2, count(*) AS c FROM {pairs} p JOIN exon b ON b.tid=p.tid2 WHERE b.s<=p.te1 AND b.e>=p.ts1 GROUP BY 1,2),
{name} AS (SELECT p.*, coalesce(q.bp,0) AS bp, coalesce(i.sh,0) AS sh,
  CASE WHEN coalesce(q.bp,0)=0 THEN CASE WHEN (p.ts1<=p.ts2 AND p.te1>=p.te2) OR (p.ts2<=p.ts1 AND p.te2>=p.te1) THEN 5 ELSE 0 END
   WHEN p.nx1=1 AND p.nx2=1 THEN 4 WHEN c1.ic=c2.ic THEN 1 WHEN coalesce(i.sh,0)>0 THEN 2
   WHEN x.c=1 OR y.c=1 THEN 6 ELSE 3 END AS status
 FROM {pairs} p LEFT JOIN {name}_b q USING (tid1,tid2) LEFT JOIN {name}_i i USING (tid1,tid2) LEFT JOIN {name}_x x USING (tid1,tid2)
 LEFT JOIN {name}_y y USING (tid1,tid2) LEFT JOIN ichain c1 ON c1.tid=p.tid1 LEFT JOIN ichain c2 ON c2.tid=p.tid2)"""


QT_PAIRS = classes("ct", "seqid, strand, is_template") + """,
qtp AS (SELECT a.tid AS tid1, b.tid AS tid2, a.ts AS ts1, a.te AS te1, b.ts AS ts2, b.te AS te2, a.nx AS nx1, b.nx AS nx2, a.clen AS clen1, b.clen AS clen2
 FROM ct a JOIN ct b ON a.seqid=b.seqid AND a.strand=b.strand AND NOT a.is_template AND b.is_template AND a.ts<=b.te AND b.ts<=a.te),
""" + relations("qt", "qtp")
