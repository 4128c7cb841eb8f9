"""Interval views derived from the line items of an order book.

An order is a transcript and its line items are exons on one of ten stranded
axes.  Neighbouring orders share exon slots, so they overlap and form genes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chains as C
from ..session import stored


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def axis_columns() -> list[Column]:
    """Columns that follow from the transcript id ``tid`` alone."""
    return [
        F.expr("concat('s', tid % 5)").alias("seqid"),
        F.expr("CASE WHEN (tid div 5) % 2 = 0 THEN '+' ELSE '-' END").alias("strand"),
        F.expr("(tid div 10) % 2 = 0").alias("is_template"),
        F.expr("concat(tid % 10, 'g', tid div 40)").alias("gene"),
    ]


def raw_exons(spark: SparkSession, sf: str) -> DataFrame:
    """(tid, s, e): one row per line item, copies and overlaps included."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    g = F.expr("l_orderkey div 40")
    s = g * 200 + (g * 7919) % 97 + (F.col("l_partkey") % 12) * 15
    return li.select(
        F.col("l_orderkey").alias("tid"),
        s.alias("s"),
        (s + 5 + (F.floor("l_quantity") % 2) * 4).alias("e"),
    )


def touching_exons(spark: SparkSession, sf: str) -> DataFrame:
    """(tid, s, e) with adjacent exons of a transcript merged; one exchange, as in :func:`_chains`.

    An exon without an end counts only where no other one has its start.
    """
    held = raw_exons(spark, sf).where("tid IS NOT NULL AND s IS NOT NULL").repartition("tid").groupBy("tid")
    one = held.agg(F.collect_set(C.interval(F.col("s"), F.col("e"))).alias("all"))
    ended = lambda x: x["e"].isNotNull() | ~F.exists("all", lambda y: (y["s"] == x["s"]) & y["e"].isNotNull())
    return one.select("tid", F.explode(C.merge(F.filter("all", ended), 1)).alias("x")).select("tid", "x.s", "x.e")


def _chains(spark: SparkSession, sf: str) -> DataFrame:
    """(tid, chain): plain rows of three numbers go through one exchange on tid, then a set per transcript.  A transcript is one row by the data model."""
    held = raw_exons(spark, sf).repartition("tid").groupBy("tid").agg(F.collect_set(C.interval(F.col("s"), F.col("e"))).alias("all"))
    return held.select("tid", C.merge(F.col("all")).alias("chain"))


def exons(spark: SparkSession, sf: str) -> DataFrame:
    """(tid, s, e, seqid, strand, is_template, gene) with disjoint exons per transcript."""
    one = _chains(spark, sf).select("tid", F.explode("chain").alias("x"))
    return one.select("tid", "x.s", "x.e", *axis_columns())


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per transcript: tid, chain, start, end and the axis columns."""
    return _chains(spark, sf).select(
        "tid", "chain",
        C.chain_start(F.col("chain")).alias("start"),
        C.chain_end(F.col("chain")).alias("end"),
        *axis_columns(),
    )


def stored_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`transcripts` as a written table, for queries that use it in several branches."""
    return stored(transcripts(spark, sf))
