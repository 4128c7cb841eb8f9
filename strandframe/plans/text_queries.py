"""Queries that write text and read it back: annotation, reads, sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import chains as C
from ..operators import genome
from ..session import ensure_checkpoint_dir
from ..sources import annotation, records
from . import sqlviews as S
from .interval_queries import coding
from .registry import query
from .table_queries import _SEQ, _sequences
from .views import stored_transcripts


def _new_path(spark, name):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _annotation_lines(spark, sf):
    """Annotation text of all transcripts; the first coding part of transcript t has the phase (t div 3) mod 3, and every 7th one says something else."""
    tx = coding(stored_transcripts(spark, sf)).withColumn("phase", F.expr("cast(tid div 3 % 3 as int)"))
    coded = C.phases_from(F.col("cds"), F.col("strand"), F.col("phase"))
    part = lambda t: lambda x: F.struct(F.lit(t).alias("type"), x["s"].alias("s"), x["e"].alias("e"), F.lit(".").alias("phase"))
    wrong = lambda x, i: F.when((F.col("tid") % 7 == 0) & (i == 1), (x["phase"] + 1) % 3).otherwise(x["phase"]).cast("string")
    rows = F.concat(
        F.transform(coded, lambda x, i: F.struct(F.lit("CDS").alias("type"), x["s"].alias("s"), x["e"].alias("e"), wrong(x, i).alias("phase"))),
        F.transform("chain", part("exon")), F.array(part("transcript")(C.interval(F.col("start"), F.col("end")))),
    )
    attrs = F.format_string('gene_id "%s"; transcript_id "%d"; zz "a"; tag "t";', "gene", "tid")
    one = tx.select("seqid", "strand", attrs.alias("attrs"), F.explode(F.coalesce(rows, F.array().cast("array<struct<type:string,s:bigint,e:bigint,phase:string>>"))).alias("f"))
    return one.select(F.concat_ws("\t", "seqid", F.lit("src"), "f.type", "f.s", "f.e", F.lit("."), "strand", "f.phase", "attrs").alias("value"))


_WALK = f"""{S.TX}, {S.CDS},
n AS (SELECT tid, strand, tid//3%3 AS p0, CASE WHEN tid%7=0 AND strand='-' AND count(*)=2 THEN (tid//3+1)%3 ELSE tid//3%3 END AS p1, min(s) AS s, max(e) AS e FROM cds GROUP BY 1,2),
w AS (SELECT cds.*, p0, p1, row_number() OVER (PARTITION BY tid ORDER BY cds.s) AS k, coalesce(sum(cds.e-cds.s+1) OVER (PARTITION BY tid ORDER BY CASE WHEN strand='-' THEN -cds.s ELSE cds.s END
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM cds JOIN n USING (tid, strand)),
ph AS (SELECT *, CAST((((p1 - b) % 3) + 3) % 3 AS INT) AS phase, CAST((((p0 - b + (tid%7=0 AND k=2)::INT) % 3) + 3) % 3 AS INT) AS declared FROM w)"""


@query("annotation_round_trip", f"""WITH {_WALK},
f AS (SELECT tid, seqid, strand, gene, ts AS start, 0 AS rank, 'transcript' AS type, ts AS s, te AS e, '.' AS phase FROM tx
 UNION ALL SELECT x.tid, x.seqid, x.strand, x.gene, ts, row_number() OVER (PARTITION BY x.tid ORDER BY x.s), 'exon', x.s, x.e, '.' FROM exon x JOIN tx USING (tid)
 UNION ALL SELECT c.tid, c.seqid, c.strand, c.gene, ts, nx + row_number() OVER (PARTITION BY c.tid ORDER BY c.s), 'CDS', c.s, c.e, CAST(phase AS VARCHAR) FROM ph c JOIN tx USING (tid))
SELECT CAST(tid AS VARCHAR) AS tid, CAST(rank AS INT) AS rank, seqid || chr(9) || 'src' || chr(9) || type || chr(9) || s || chr(9) || e || chr(9) || '.' || chr(9) || strand || chr(9) || phase || chr(9)
 || 'transcript_id "' || tid || '"; gene_id "' || gene || '";' || CASE WHEN type='transcript' THEN ' tag "t"; zz "a";' ELSE '' END AS value FROM f""")
def annotation_round_trip(spark, sf):
    """Lines -> transcripts -> ordered text -> transcripts -> lines; the declared phase of the first part rules."""
    tx = annotation.assemble(annotation.with_ids(annotation.features(_annotation_lines(spark, sf))))
    path = _new_path(spark, "annotation")
    annotation.write_transcripts(tx, path)
    again = annotation.assemble(annotation.with_ids(annotation.features(annotation.read_lines(spark, path))))
    return annotation.transcript_lines(again).select("tid", "rank", "value")


@query("phase_report", f"""WITH {_WALK},
r AS (SELECT tid, any_value(p1) AS phase, coalesce(string_agg(s||'-'||e||':'||declared, ',' ORDER BY s) FILTER (declared<>phase), '') AS off FROM ph GROUP BY tid),
c AS (SELECT tid, string_agg(greatest(s, lo)||'-'||least(e, hi), ',' ORDER BY s) AS coding FROM
 (SELECT x.tid, x.s, x.e, CASE WHEN x.strand='-' THEN n.s ELSE n.s+p1 END AS lo, CASE WHEN x.strand='-' THEN n.e-p1 ELSE n.e END AS hi FROM exon x JOIN n USING (tid))
 WHERE greatest(s, lo) <= least(e, hi) GROUP BY tid)
SELECT CAST(t.tid AS VARCHAR) AS tid, CAST(coalesce(phase, 0) AS INT) AS phase, coalesce(off, '') AS off, coalesce(coding, '-') AS coding
FROM tx t LEFT JOIN r ON r.tid=t.tid LEFT JOIN c ON c.tid=t.tid""")
def phase_report(spark, sf):
    """The declared phase, the coding parts that disagree with it, and the coding chain from the first whole codon on."""
    tx = annotation.coding_transcripts(annotation.assemble(annotation.with_ids(annotation.features(_annotation_lines(spark, sf)))))
    off = F.array_join(F.transform("off_phase", lambda x: F.concat(x["s"].cast("string"), F.lit("-"), x["e"].cast("string"), F.lit(":"), x["phase"].cast("string"))), ",")
    return tx.select("tid", "phase", off.alias("off"), C.as_text(F.col("coding")).alias("coding"))


@query("fastq_scan", f"SELECT 'd' || doc_id AS name, {_SEQ} AS seq, translate({_SEQ}, 'ACGT', '@+I~') AS quality FROM documents")
def fastq_scan(spark, sf):
    """Documents as reads of four lines in several files; qualities may begin like headers."""
    d = _sequences(spark, sf)
    path = _new_path(spark, "reads")
    four = F.concat(F.lit("@d"), "doc_id", F.lit(" x\n"), "seq", F.lit("\n+\n"), F.translate("seq", "ACGT", "@+I~"))
    d.select(four.alias("value")).write.text(path)
    return records.read_fastq(spark, path)


@query("fasta_tiles", f"""WITH d AS (SELECT 'd' || doc_id AS name, {_SEQ} AS seq FROM documents)
SELECT name, CAST(k AS INT) AS chunk_no, substring(seq, k*1024+1, 1024) AS seq FROM (SELECT name, seq, unnest(range((length(seq)+1023)//1024)) AS k FROM d)""")
def fasta_tiles(spark, sf):
    """Documents as sequences in lines of 70 bases, read into tiles line by line."""
    path = _new_path(spark, "sequences")
    wrapped = F.array_join(F.regexp_extract_all("seq", F.lit("(.{1,70})"), F.lit(1)), "\n")
    _sequences(spark, sf).select(F.concat(F.lit(">d"), "doc_id", F.lit(" doc\n"), wrapped).alias("value")).write.text(path)
    return genome.tiles_of_lines(annotation.read_lines(spark, path), 1024)
