"""Queries without SQL on whole given tables: brute force, the tokenizers themselves, held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from strandframe.llm import token_counts
from strandframe.llm.queries import QUERIES, tokenizer_file

DATA = "/root/testdata"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}


def test_bpe(spark, texts):
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(tokenizer_file())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = QUERIES["op10_bpe"](spark, f"{DATA}/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = reader.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == sha(reader.decode(ids, skip_special_tokens=False))


def test_token_counts(spark, texts):
    encoding = token_counts._encoding(tokenizer_file("byte_bpe_50k.tiktoken"))
    lengths = Counter(len(encoding.encode_ordinary(t)) for t in texts.values())
    got = QUERIES["op6_token_counts"](spark, f"{DATA}/sf0.01").collect()
    assert {r.n_tokens: r.n_docs for r in got} == lengths
    for r in got[:: max(1, len(got) // 50)]:
        assert r.docs_at_least == sum(n for k, n in lengths.items() if k >= r.n_tokens)
        assert r.truncated_tokens == sum(n * min(k, r.n_tokens) for k, n in lengths.items())


def test_secrets(spark, texts):
    value = re.compile(r"[A-Za-z0-9+/_\-]{16,}")
    expected = Counter()
    for i, t in texts.items():
        for w in t.split():
            expected.update((i, hashlib.sha256(v.encode()).hexdigest()) for v in value.findall(w) if re.search("[0-9]", v))
    got = QUERIES["op8_secrets"](spark, f"{DATA}/sf0.01").collect()
    assert Counter((r.doc_id, r.value_sha256) for r in got) == expected
    assert 0 < sum(r.is_secret for r in got) < len(got)


def test_toxicity_held_out(spark):
    got = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, f"{DATA}/sf0.1").collect()}
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").select("doc_id")
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    known = [(got[r.doc_id], r.toxic) for r in spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").collect() if got[r.doc_id].held_out]
    languages = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").select("doc_id", "lang").collect()}
    toxic = [r.predicted for r, t in known if t == 1]
    clean = [r.predicted for r, t in known if t == 0]
    assert sum(toxic) >= 0.92 * len(toxic) and sum(clean) <= 0.01 * len(clean)
    for lang in ("de", "en", "es", "fr"):
        own = [r.predicted for r, t in known if t == 1 and languages[r.doc_id] == lang]
        assert sum(own) >= 0.85 * len(own) > 0  # of 15 German ones one has no word that any other toxic text has
