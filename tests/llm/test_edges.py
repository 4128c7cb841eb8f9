"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest

from strandframe.llm import bpe, decontaminate, exact_dedup, licenses, secrets, token_counts, toxicity
from strandframe.llm.queries import tokenizer_file

ITEM = "one two three four five six seven eight nine ten eleven"
TEXTS = [None, "", " \n", "a", "a", "All RIGHTS\nreserved! x", "y " + ITEM.upper() + " z", "Released under the MIT License.", "x" * 50000, 'token = "' + "a1b2" * 10 + '"', "1234567812345678 ok"]
ROWS = [(i, t, "id") for i, t in enumerate(TEXTS)] + [(None, "a", "m"), (4, "a", "m")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, id string").withColumnsRenamed({"id": "mark"})


def test_exact_dedup(docs):
    got = [tuple(r) for r in exact_dedup.exact_duplicates(docs).collect()]
    assert len(got) == len(ROWS)
    copies = [g for g in got if g[4] == hashlib.sha256(b"a").hexdigest()]
    assert {(g[1], g[2]) for g in copies} == {(4, 4)} and sum(g[3] for g in copies) == 1
    assert sorted((g[0], g[1], g[3]) for g in got if g[4] == hashlib.sha256(b"").hexdigest()) == [(0, 1, False), (1, 1, True)]
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (None, "Reserved"), (10, "a")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect() if r.doc_id is not None}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[6].n_words, got[6].n_hit, got[6].n_items, got[6].items_sha256) == (13, 11, 1, sha("1"))
    assert (got[5].n_hit, got[5].n_items, got[5].contaminated, got[5].items_sha256) == (1, 0, True, sha(""))
    assert (got[4].n_hit, got[4].items_sha256, got[0].n_words, got[0].contaminated) == (1, sha("10"), 0, False)
    assert decontaminate.contamination(docs, items).count() == len(ROWS)
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 7, 8, 9, 10]


def test_licenses(docs):
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert (got[5].n_base, got[5].first_word, got[5].last_word, got[5].base_labels, got[5].score) == (1, 0, 0, "reserved", 1.0)
    assert (got[7].labels, got[7].base_labels, got[7].n_base, got[7].first_word) == ("mit", "", 0, None)
    assert (got[0].n_words, got[0].labels, got[0].score) == (0, "", 0.0)
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_bpe(docs):
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(tokenizer_file())
    got = bpe.decode(bpe.encode(docs, tokenizer_file()), tokenizer_file()).collect()
    for r in got:
        ids = reader.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == reader.decode(ids, skip_special_tokens=False)
    assert len(got) == len(ROWS) and bpe.round_trip(docs.limit(0), tokenizer_file()).count() == 0


def test_token_counts(spark):
    lengths = spark.createDataFrame([(0, 2), (5, 1), (3000, 4)], "n_tokens long, n_docs long")
    got = sorted(tuple(r) for r in token_counts.suffix_sums(lengths).collect())
    assert [g[:4] + g[5:] for g in got] == [(0, 2, 7, 12005, 0), (5, 1, 5, 12005, 25), (3000, 4, 4, 12000, 12005)]
    none = token_counts.suffix_sums(lengths.limit(0))
    assert none.count() == token_counts.limit_answers(none, [1]).count() == token_counts.quantile_answers(none, [0.5]).count() == 0
    own = [0, 0, 5] + [3000] * 4
    sums = token_counts.suffix_sums(lengths)
    for r in token_counts.limit_answers(sums, [0, 1, 5, 6, 3000, 9999]).collect():
        c = r.context_limit
        assert (r.docs_at_least, r.truncated_tokens) == (sum(n >= c for n in own), sum(min(n, c) for n in own)) and r.lost_tokens == sum(own) - r.truncated_tokens
    got = {r.quantile: r.n_tokens for r in token_counts.quantile_answers(sums, [0.0, 0.25, 0.3, 0.43, 0.5, 1.0]).collect()}
    assert got == {0.0: 0, 0.25: 0, 0.3: 5, 0.43: 3000, 0.5: 3000, 1.0: 3000}


def test_token_counts_of_odd_rows(docs):
    got = {r.n_tokens: r.n_docs for r in token_counts.histogram(docs.withColumn("n_tokens", token_counts.F.lit(1)), tokenizer_file("byte_bpe_50k.tiktoken")).collect()}
    assert sum(got.values()) == len(ROWS) and got[0] == 2


def test_secrets(docs):
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert set(got) == {9, 10} and got[9].is_secret and not got[10].is_secret
    assert secrets.scan(docs.limit(0)).count() == 0


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == len(ROWS) and {r.predicted for r in got} == {0} and all(0 <= r.score < 0.5 for r in got)
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_secrets_in_one_token(spark):
    key = "a1b2" * 6
    rows = [(1, f"x AWS_SECRET_ACCESS_KEY={key};session_token_value={key[::-1]} y"), (2, "see http://host/" + "c3d4" * 6), (3, "12345678901234567")]
    got = {(r.doc_id, r.nth): r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, 1), (1, 3), (2, 0), (3, 0)}
    assert got[1, 1].value_sha256 == hashlib.sha256(key.encode()).hexdigest() and got[1, 1].is_secret and got[1, 3].is_secret
    assert not got[2, 0].is_secret and not got[3, 0].is_secret


def test_secrets_from_findings(spark):
    rows = [(i, f"value {'q7' * 9} at" if i % 2 else f"build {'1' * 18} at") for i in range(40)]
    found = spark.createDataFrame([(i, 1, 0, i % 2) for i in range(40)], "id long, at int, nth int, label int")
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), found).collect()
    assert len(got) == 40 and all(r.is_secret == (r.doc_id % 2 == 1) for r in got)


def test_look_ups_by_broadcast_and_by_shuffle(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, ITEM), (2, "Reserved"), (3, "the mit license")], "item_id long, text string")
    both = []
    for size, rows in ((decontaminate.BROADCAST_BYTES, secrets.BROADCAST_ROWS), (-1, -1)):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", size)
        monkeypatch.setattr(secrets, "BROADCAST_ROWS", rows)
        found = decontaminate.contamination(docs, items)
        both.append((sorted(map(tuple, found.collect()), key=str), sorted(map(tuple, secrets.scan(docs).collect()))))
    assert both[0] == both[1] and sum(r[5] for r in both[0][0]) == 3


def test_a_text_that_stands_twice_under_one_id(spark):
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (1, ITEM.upper()), (None, ITEM), (1, "x")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contamination(docs, docs.selectExpr("doc_id AS item_id", "text").where("doc_id IS NOT NULL AND text <> 'x'")).collect())
    assert got == [(0, 11, 11, True), (1, 1, 0, False), (1, 11, 11, True), (1, 11, 11, True), (1, 11, 11, True)]
