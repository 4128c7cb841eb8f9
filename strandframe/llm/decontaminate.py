"""Benchmark decontamination as a prefix-filtered join, in DataFrame operations only.

Items are cut into windows.  Containment is exact, so a window's prefix is one token: a text that holds the window holds
each of its two-word shingles, in particular the one that is rarest over all texts.

1. One scan cuts every text, keeps the positions of shingles that some window has, and counts the words.
2. Counted over all texts, they tell the rarest shingle of each window and its offset.
3. A kept position of that shingle gives a start (position bound: not before the text's first word) and an end (length
   bound: not after its last).
4. The words from start to end are compared with the window's, in the texts that have such a position.

Rows stay linear: a position meets only windows whose rarest shingle stands there.  Look-up tables are broadcast while their
measured size is below ``BROADCAST_BYTES``; above it the same joins are shuffles, where adaptive execution splits hot keys.
Windows of a single word use the word as their shingle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .textcols import az_lower, az_lower_all, with_found, words_of

#: Measured size up to which the table of windows is broadcast.
BROADCAST_BYTES = 48 << 20


def _shingle(words: Column, at: Column, kind: int) -> Column:
    """A number for the one or two words at a position; null at the end.  Words fully lower-cased one by one, so never too strict."""
    word = lambda i: F.lower(F.get(words, i))
    if kind == 1:
        return F.xxhash64(word(at))
    return F.when(at + 1 < F.size(words), F.xxhash64(word(at), word(at + 1)))


def item_windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, item, words): every run of ``size`` words of an item; a shorter item, unless empty, is one window."""
    cut = items.select(F.col(id_col).cast("string").alias("item"), words_of(az_lower(F.col(text_col))).alias("ws")).where(F.size("ws") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("ws") - size + 1, F.lit(1)))).alias("i")
    return cut.select("item", "ws", start).select("item", F.slice("ws", F.col("i"), F.lit(size)).alias("words")).distinct()


def _small(df: DataFrame, row_bytes: int, text: str | None = None) -> DataFrame:
    """With a broadcast hint if its measured size allows."""
    size = F.lit(row_bytes) + (F.aggregate(text, F.lit(0), lambda a, w: a + F.octet_length(w) + 16) if text else 0)
    total = df.agg(F.sum(size)).head()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, body): rows with equal id and mark (SHA-256 of the text) have equal texts and hence equal results."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(body, 256)).alias("mark"), body.alias("body"))


def _same(left: DataFrame, right: DataFrame):
    return left["id"].eqNullSafe(right["_id"]) & (left["mark"] == right["_mark"])


def _tokens(windows: DataFrame, kind: int) -> DataFrame:
    offsets = F.explode(F.sequence(F.lit(0), F.size("words") - kind)).alias("offset")
    return windows.where(F.size("words") == 1 if kind == 1 else F.size("words") > 1).select("item", "words", offsets).withColumn("token", _shingle(F.col("words"), F.col("offset"), kind))


def _scan(rows: DataFrame, tokens: DataFrame, kind: int) -> DataFrame:
    """(id, mark, n, at, token): positions with one of ``tokens``, and for each row one without (token null) that brings n."""
    words = rows.select("id", "mark", words_of(F.col("body")).alias("ws")).select("id", "mark", "ws", F.posexplode_outer("ws").alias("at", "word"))
    n = F.size("ws")
    every = words.select("id", "mark", n.alias("n"), "at", _shingle(F.col("ws"), F.col("at"), kind).alias("here"))
    asked = _small(tokens.select("token").distinct(), 16)
    met = every.join(asked, every["here"] == asked["token"], "left")
    return stored(met.where(F.col("token").isNotNull() | F.col("at").isNull() | (F.col("at") == F.col("n") - 1)).select("id", "mark", "n", "at", "token"))


def _rarest(tokens: DataFrame, places: DataFrame) -> DataFrame:
    """Windows with token and offset of the shingle that is rarest over all texts."""
    seen = places.where("token IS NOT NULL").groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    ranked = tokens.join(seen, "token", "left").withColumn("order", F.struct(F.coalesce("seen", F.lit(0)), "token", "offset"))
    best = ranked.groupBy("item", "words").agg(F.min("order").alias("o"))
    return best.select("item", "words", F.size("words").alias("length"), F.col("o.token").alias("token"), F.col("o.offset").alias("offset"))


def occurrences(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, mark, start, length, item): where a window of an item stands in a text (words from 0), each once for equal rows; and
    (id, mark, n) with the number of words of each row."""
    rows = _keyed(docs, id_col, text_col)
    windows = stored(item_windows(items, size))
    maybe, counts = None, None
    for kind in (2, 1):
        tokens = _tokens(windows, kind)
        if kind == 1 and not tokens.head(1):
            continue
        places = _scan(rows, tokens, kind)
        counts = places if counts is None else counts
        start = F.col("at") - F.col("offset")
        met = places.join(_small(stored(_rarest(tokens, places)), 64, "words"), "token").where((start >= 0) & (start + F.col("length") <= F.col("n")))
        met = met.select("id", "mark", start.alias("start"), "length", "words", "item").distinct()
        maybe = met if maybe is None else maybe.union(met)
    maybe = stored(maybe.withColumnsRenamed({"id": "_id", "mark": "_mark"}))
    which = _small(maybe.select("_id", "_mark").distinct(), 96)
    texts = rows.join(which, _same(rows, which), "left_semi").distinct().select("id", "mark", words_of(F.col("body")).alias("ws"))
    tried = _small(maybe, 96, "words")
    found = texts.join(tried, _same(texts, tried)).where(az_lower_all(F.slice("ws", F.col("start") + 1, F.col("length"))) == F.col("words"))
    per_row = counts.where("at IS NULL OR at = n - 1").select("id", "mark", F.greatest("n", F.lit(0)).cast("long").alias("n"))
    return found.select("id", "mark", "start", "length", "item"), per_row


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if any window of an item stands over it.  A null or empty text has no words; items without words match
    nothing; items with a null id hit but are not listed.  Equal items and repeated rows are answered each; other columns
    are ignored.  An empty benchmark leaves everything clean.
    """
    hits, rows = occurrences(docs, items, size, id_col, text_col)
    hits = stored(hits)
    ends = hits.groupBy("id", "mark", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = Window.partitionBy("id", "mark").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    n_hit = ends.withColumn("new", new).groupBy("id", "mark").agg(F.sum("new").alias("n_hit"))
    listed = hits.groupBy("id", "mark").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = with_found(with_found(rows.withColumnRenamed("n", "n_words"), n_hit), listed)
    hit, names = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "n_words", hit.cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of an item stands."""
    dirty = occurrences(docs, items, size, id_col, text_col)[0].select(F.col("id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    dirty = _small(stored(dirty), 96)
    mark = F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))
    return docs.join(dirty, docs[id_col].eqNullSafe(dirty["_id"]) & (mark == dirty["_mark"]), "left_anti")
