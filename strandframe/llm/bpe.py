"""BPE encoding and decoding through a table of distinct words.

A word is what stands between ASCII white space.  The tokenizer drops white space, and neither its normaliser nor its
splitting, merges or special tokens look across it, so a text's ids are the concatenation of its words' ids.

1. Every source sends each owner (a range of word hashes) its distinct words, sorted and compressed.
2. An owner encodes each distinct word once and answers every source with the ids of its words, in the order they came.
3. A second scan joins the ids back by position, source by source.  A word that the source's own table lacks (the scan was
   cut in another way) is encoded on the spot, so the result never depends on the layout.

Decoding joins ids with the id-to-piece table, whose size is bounded by the vocabulary.  The tokenizer file has no
decoder, so pieces are joined by a space.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tools

#: Text bytes for each owner.
PER_OWNER = 4 << 20
#: Texts and distinct words handled at a time.
AT_ONCE = 2000

_SENT = pa.schema([("src", pa.int32()), ("owner", pa.int32()), ("words", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary())])
_DDL = "src int, owner int, words binary, ids binary, sizes binary"


@lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def _encode(tokenizer, words: list[bytes]) -> Iterator[list[int]]:
    for i in range(0, len(words), AT_ONCE):
        texts = [w.decode() for w in words[i : i + AT_ONCE]]
        yield from (e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False))


def _send(owners: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set[bytes] = set()
        for batch in it:
            for text in tools.utf8(batch.column(0)):
                own.update(text.split())
        to: list[list[bytes]] = [[] for _ in range(owners)]
        for w in own:
            to[xxhash.xxh64_intdigest(w) * owners >> 64].append(w)
        yield from tools.batches(
            ({"src": tools.source(), "owner": o, "words": zlib.compress(b"\n".join(sorted(ws)), 3), "ids": None, "sizes": None} for o, ws in enumerate(to) if ws), _SENT
        )

    return run


def _answer(path: str):
    def run(got: pa.Table) -> pa.Table:
        rows = got.to_pylist()
        lists = [zlib.decompress(r["words"]).split(b"\n") for r in rows]
        words = list(set().union(*lists))
        table = dict(zip(words, _encode(_tokenizer(path), words)))
        for r, ws in zip(rows, lists):
            ids = [table[w] for w in ws]
            r["ids"] = zlib.compress(np.fromiter((i for x in ids for i in x), np.int32).tobytes(), 1)
            r["sizes"] = zlib.compress(np.fromiter(map(len, ids), np.int32, len(ids)).tobytes(), 1)
        return pa.Table.from_pylist(rows, _SENT)

    return run


class _Words(dict):
    """word -> its ids, as the bytes of an int32 array."""

    def __init__(self, path: str, folder: str):
        self.tokenizer = _tokenizer(path)
        for r in tools.published(folder, tools.source()):
            ids = zlib.decompress(r["ids"])
            ends = np.cumsum(4 * np.frombuffer(zlib.decompress(r["sizes"]), np.int32).astype(np.int64)).tolist()
            self.update(zip(zlib.decompress(r["words"]).split(b"\n"), [ids[a:b] for a, b in zip([0, *ends], ends)]))

    def __missing__(self, word: bytes) -> bytes:
        (ids,) = _encode(self.tokenizer, [word])
        self[word] = out = np.array(ids, np.int32).tobytes()
        return out

    def encoded(self, text: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), np.int32)


def _pieces(tokenizer) -> list[str]:
    """The id-to-piece table."""
    return [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]


def _word_table(docs: DataFrame, text_col: str, path: str) -> str:
    spark = docs.sparkSession
    tools.pin_layout(spark)
    body = docs.select(F.col(text_col).alias("body"))
    size = body.agg(F.sum(F.octet_length("body"))).head()[0] or 0
    sent = body.mapInArrow(_send(tools.owners_for(spark, size, PER_OWNER)), _DDL)
    return tools.publish(tools.ask_owners(sent, _answer(path), _DDL), "words")


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as an array; a null or blank text has none.  ``path``: the tokenizer's file."""
    folder = _word_table(docs, text_col, path)

    @F.pandas_udf("array<int>")
    def ids_of(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _Words(path, folder)
        for s in it:
            yield pd.Series([words.encoded((x or "").encode()) for x in s])

    return docs.withColumn(ids_col, ids_of(F.coalesce(F.col(text_col), F.lit(""))))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the decoded text of each array of ids (null: empty), special tokens included."""

    @F.pandas_udf("string")
    def text_of(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = _pieces(_tokenizer(path))
        for s in it:
            yield pd.Series([" ".join([pieces[i] for i in (x if x is not None else ())]) for x in s])

    return docs.withColumn(text_col, text_of(ids_col))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256; encoded and decoded in one pass.

    A null text counts as empty and has no tokens.  Other columns are ignored, repeated rows are answered each.
    """
    folder = _word_table(docs, text_col, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = _Words(path, folder)
        pieces = _pieces(words.tokenizer)
        numbers = [str(i) for i in range(len(pieces))]

        def answer(text: str | None) -> tuple[int, str, str]:
            ids = words.encoded((text or "").encode()).tolist()
            return len(ids), *(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest() for names in (numbers, pieces))

        for s in it:
            yield pd.DataFrame([answer(x) for x in s], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(id_col).alias("id"), digest(F.coalesce(F.col(text_col), F.lit(""))).alias("d"))
    return out.select(F.col("id").alias(id_col), "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
