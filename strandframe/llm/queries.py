"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, exact_dedup, licenses, periodic_runs, secrets, sharding, simhash, substring_dedup, token_counts, toxicity, warc, whitening
from .tools import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op4_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file())


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))

#: The words of a column in DuckDB.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op7_decontaminate"] = f"""
WITH items AS (SELECT item_id, {_WORDS.format("text")} AS ws FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
docs AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS ws FROM documents),
places AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS i FROM docs, (SELECT DISTINCT n FROM wins))),
hits AS (SELECT DISTINCT p.doc_id, p.i, p.n, w.item_id FROM places p JOIN wins w USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"('{label}', {quoted(words)}, {need}, {n})" for label, words, need, n in licenses.needed(licenses.TEMPLATES, licenses.THRESHOLD))
    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in licenses.PHRASES.items())
    return f"""
WITH templates(label, tw, need, n) AS (VALUES {templates}), phrases(pw, label) AS (VALUES {phrases}),
docs AS (SELECT doc_id, text, coalesce({_WORDS.format("text")}, []) AS ws FROM documents),
spots AS (SELECT doc_id, label, i FROM (SELECT doc_id, ws, pw, label, unnest(range(1, len(ws) + 1)) AS i FROM docs, phrases) WHERE ws[i:i + len(pw) - 1] = pw),
near AS (
  SELECT doc_id, label, len(tw) AS size, need, max(len(list_intersect(ws[i:i + n - 1], tw))) AS held
  FROM (SELECT doc_id, ws, label, tw, need, n, unnest(range(1, len(ws) + 1)) AS i FROM docs, templates) WHERE list_contains(tw, ws[i]) GROUP BY ALL),
found AS (
  SELECT doc_id, label, i - 1 AS i, 1.0::DOUBLE AS score FROM spots
  UNION ALL SELECT doc_id, label, NULL, held / size FROM near WHERE held >= need),
of_doc AS (
  SELECT doc_id, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word, max(score) AS score, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (i IS NOT NULL) AS base_labels
  FROM found GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN of_doc USING (doc_id)
"""


ORACLES["op9_licenses"] = _license_sql()


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


ORACLES["op3_warc"] = """
SELECT page_id, size AS payload_bytes, sha256(body) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN low END AS refers_to
FROM (SELECT page_id, body, strlen(body)::BIGINT AS size, min(page_id) OVER w AS low, strlen(body) >= 100 AND page_id > min(page_id) OVER w AS again
      FROM (SELECT page_id, coalesce(html, '') AS body FROM pages) WINDOW w AS (PARTITION BY body))
"""


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken")))


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


#: Shards of the registered query, of equal weight, and the one that joins them.
SHARDS, GROWN = dict.fromkeys(range(24), 1.0), {24: 1.0}


@query
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assigned(table(spark, sf_dir, "documents"), SHARDS, GROWN)


# With equal weights the largest draw wins.  SQL has no CRC-32: its table is made bit by bit.
ORACLES["op12_sharding"] = f"""
WITH octets AS (
  SELECT [list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) FOR i IN range(256)] AS step),
bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents),
sums AS (
  SELECT doc_id, len(b)::BIGINT + 8 AS size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM bytes, octets),
draws AS (SELECT doc_id, s, ('0x' || substr(md5(doc_id || ':' || s), 1, 12))::BIGINT AS drawn FROM (SELECT DISTINCT doc_id FROM documents), range({len(SHARDS) + len(GROWN)}) t(s)),
homes AS (SELECT doc_id, arg_max(s, drawn) FILTER (s < {len(SHARDS)}) AS shard, arg_max(s, drawn) AS grown FROM draws GROUP BY 1)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, crc, size) - 1 AS slot, grown::INT AS grown_shard
FROM sums JOIN homes USING (doc_id)
"""


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"), rewritten=True)
