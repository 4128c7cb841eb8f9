"""Queries on sequences: transcripts placed on documents, whose characters stand for bases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chains as C
from ..operators import genome
from . import sqlviews as S
from .interval_queries import coding
from .registry import query
from .table_queries import _SEQ, _sequences
from .views import stored_transcripts, table

_TILE = 1024


def _placed(spark, sf):
    """Transcripts of one group and axis lie on one document, counted from the group's origin."""
    n = table(spark, sf, "documents").count()
    move = lambda x: C.interval(x["s"] - F.expr("tid div 40 * 200") + 1, x["e"] - F.expr("tid div 40 * 200") + 1)
    tx = stored_transcripts(spark, sf).withColumn("chain", F.transform("chain", move))
    return tx.withColumns({
        "seqid": F.expr(f"cast((tid div 40 * 5 + tid % 5) % {n} as string)"), "start": C.chain_start(F.col("chain")), "end": C.chain_end(F.col("chain")),
    })


def _tiles(spark, sf):
    return genome.tiles(_sequences(spark, sf).select(F.col("doc_id").cast("string").alias("name"), F.coalesce("seq", F.lit("")).alias("seq")), _TILE)


@query("chain_sequences", f"""WITH {S.TX}, n AS (SELECT count(*) AS n FROM documents),
p AS (SELECT tid, strand, coalesce(string_agg(substring({_SEQ}, s - tid//40*200 + 1, e - s + 1), '' ORDER BY s), '') AS fwd
 FROM exon, n, documents WHERE doc_id = (tid//40*5 + tid%5) % n GROUP BY 1, 2)
SELECT tid, CASE WHEN strand='-' THEN reverse(translate(fwd, 'ACGT', 'TGCA')) ELSE fwd END AS rna FROM p""")
def chain_sequences(spark, sf):
    return genome.chain_sequences(_placed(spark, sf), _tiles(spark, sf), _TILE).select("tid", "rna")


@query("orf_transfer_sequence")
def orf_transfer_sequence(spark, sf):
    return genome.transfer_with_sequence(coding(_placed(spark, sf)), _tiles(spark, sf), _TILE)
