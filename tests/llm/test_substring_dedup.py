"""Repeated passages against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from strandframe.llm import substring_dedup


def plain(texts, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        yield len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()


@pytest.mark.parametrize("size,chunk", [(35, 8 << 20), (3, 60), (1, 200)])
def test_against_brute_force(spark, tmp_path, size, chunk):
    rng = random.Random(size)
    fresh = lambda n: " ".join("w%d" % rng.randrange(50 if size < 35 else 10**6) for _ in range(n))
    passage = fresh(60)
    texts = [None, "", " \n\t", "w1", fresh(34), fresh(35), "é\xa0x " * 200, "a  b\x0bc"]
    texts += [fresh(rng.randrange(5, 90)) + " " + passage + "\n" + fresh(9) for _ in range(20)] + [fresh(100) for _ in range(20)]
    texts += [texts[-1]] * 5 + [passage + " " + passage]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[10], "x"), (None, texts[11], None)]
    folder = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, body string").repartition(4).write.parquet(folder)
    want = sorted(((r[0], *p) for r, p in zip(rows, plain([t for _, t, _ in rows], size))), key=repr)
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(spark.read.parquet(folder), size, chunk=chunk).collect()), key=repr)
    assert got == want


def test_empty_and_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c a b d")], "doc_id long, text string")
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0
    folder = str(tmp_path / "docs")
    df.write.parquet(folder)
    assert substring_dedup.remove_repeats(spark.read.parquet(folder), 2, with_text=True).head().kept == "c d"


def test_window_values_do_not_depend_on_portions(monkeypatch):
    rng = random.Random(2)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(n)] for n in (0, 3, 90, 1, 35, 400, 34, 36)]
    whole = substring_dedup._window_keys(texts, 35, substring_dedup._Numbers())
    monkeypatch.setattr(substring_dedup, "PORTION", 40)
    parts = substring_dedup._window_keys(texts, 35, substring_dedup._Numbers())
    assert all((x == y).all() for x, y in zip(whole, parts)) and len(whole[0]) == sum(max(0, len(t) - 34) for t in texts)
    of = [tuple(t[i : i + 35]) for t in texts for i in range(len(t) - 34)]
    assert len(set(zip(*(x.tolist() for x in whole)))) == len(set(of))
    assert len(substring_dedup._window_keys([], 35, substring_dedup._Numbers())[0]) == 0
