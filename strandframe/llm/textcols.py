"""Words as columns, without Python on the executors."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of 0-9, A-Z, a-z and everything beyond ASCII; with A-Z lower-cased these are the words of the contract.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, letters as they stand; none for a null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def az_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def az_lower_all(words: Column) -> Column:
    return F.transform(words, az_lower)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, body): rows with equal id and mark have equal texts and hence equal results."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("mark"), body.alias("body"))


def with_found(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``found`` for equal id and mark, null ids included; nulls where there are none."""
    other = found.withColumnsRenamed({"id": "_id", "mark": "_mark"})
    return rows.join(other, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").drop("_id", "_mark")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it as long as a column is called so, in either case."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def rows_at(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs``, all columns, that ``kept`` (id, sha, repeated) names: one for each of its rows.

    ``sha`` is the text's SHA-256, a null text counts as empty.  Rows with equal id and text are told apart by their other
    columns only; where ``repeated`` is set, the smallest stays (columns that hold maps, which have no order, by their JSON).
    Columns of ``docs`` may have any names and types.
    """
    i, s, r, whole = (free_name(n, docs.columns) for n in ("_id", "_sha", "_repeated", "_row"))
    other = kept.withColumnsRenamed({"id": i, "sha": s, "repeated": r})
    same = docs[id_col].eqNullSafe(F.col(i)) & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == F.col(s))
    single = docs.join(other.where(f"not {r}"), same, "left_semi")
    order = F.struct(*[F.to_json(F.struct(docs[c])) if "map<" in t else docs[c] for c, t in docs.dtypes])
    shared = docs.join(other.where(r), same).groupBy(i, s).agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), order).alias(whole))
    return single.unionByName(shared.select(f"{whole}.*"))
