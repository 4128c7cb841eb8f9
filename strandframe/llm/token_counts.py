"""Exact token counts by a length histogram.

Texts are counted once and aggregated by encoded length; a row of the result stands for a length, and suffix sums answer
totals, quantiles and truncated totals for every context limit.  The sums run within blocks of lengths first, then over one
row for each block, so no task holds the histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

#: Lengths whose sums are formed together.
BLOCK = 128


@lru_cache(1)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def histogram(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs) over all rows; a null or empty text has length 0, special tokens' strings are ordinary text."""

    @F.pandas_udf(T.LongType())
    def length(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path)
        for s in it:
            yield pd.Series([len(encoding.encode_ordinary(x)) if x else 0 for x in s], dtype="int64")

    return docs.select(length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_tokens")).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """``lengths`` with docs_at_least, tokens_at_least, share_below (of the rows) and truncated_tokens, the sum of min(length, n_tokens).

    Any limit between two lengths follows from the next larger row: truncated(c) = all tokens - tokens_at_least + c *
    docs_at_least.  An empty table gives an empty result.
    """
    rows = stored(lengths).withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total = lambda c: F.sum(c).over(every)
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t"), total("d").alias("all_d"), total("t").alias("all_t"))
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    docs = F.sum("n_docs").over(within) + F.col("d")
    tokens = F.sum(F.col("n_docs") * F.col("n_tokens")).over(within) + F.col("t")
    out = rows.join(blocks, "block").select("n_tokens", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), "all_d", "all_t")
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", (1 - F.col("docs_at_least") / F.col("all_d")).alias("share_below"),
        (F.col("all_t") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
    )


def limit_answers(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_at_least, truncated_tokens, lost_tokens) for any limits, also between and beyond the lengths of ``sums``.

    One aggregate over the result of :func:`suffix_sums`; no row for an empty table.
    """
    own = F.struct("n_tokens", "docs_at_least", "tokens_at_least")
    asked = [F.struct(F.lit(c).cast("long").alias("c"), F.min(F.when(F.col("n_tokens") >= c, own)).alias("r")) for c in limits]
    rows = sums.agg(F.max("tokens_at_least").alias("all_t"), F.array(*asked).alias("a")).where("all_t IS NOT NULL")
    rows = rows.select("all_t", F.explode("a").alias("x")).select("all_t", F.col("x.c").alias("c"), "x.r")
    docs, tokens = F.coalesce("r.docs_at_least", F.lit(0)), F.coalesce("r.tokens_at_least", F.lit(0))
    cut = F.col("all_t") - tokens + F.col("c") * docs
    return rows.select(F.col("c").alias("context_limit"), docs.alias("docs_at_least"), cut.alias("truncated_tokens"), (F.col("all_t") - cut).alias("lost_tokens"))


def quantile_answers(sums: DataFrame, quantiles: list[float]) -> DataFrame:
    """(quantile, n_tokens): the smallest length that at least this share of the rows does not exceed; no row for an empty table."""
    # share_below leaves out the rows of the length itself, which n_docs adds
    all_d = F.col("docs_at_least") / (1 - F.col("share_below"))
    rows = sums.withColumn("all_d", F.round(all_d))
    upto = F.col("all_d") - F.col("docs_at_least") + F.col("n_docs")
    asked = [F.struct(F.lit(float(q)).alias("quantile"), F.min(F.when(upto >= F.ceil(F.lit(float(q)) * F.col("all_d")), F.col("n_tokens"))).alias("n_tokens")) for q in quantiles]
    return rows.agg(F.array(*asked).alias("a")).select(F.explode("a").alias("x")).select("x.*").where("n_tokens IS NOT NULL")
