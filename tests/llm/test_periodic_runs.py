"""Runs of words against the definition: every start and every period tried."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from strandframe.llm import periodic_runs as pr
from strandframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_runs(ws):
    """By definition: maximal stretches of every period, of which the smallest period counts."""
    best = {}
    for q in range(1, len(ws) // 3 + 1):
        i = 0
        while i + q < len(ws):
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                best.setdefault((i, j + q - i), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(ws), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[a + (i - a) % p] if i >= a else ws[i] for i in range(n)]
    runs = plain_runs(ws)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, top[0] if top[0] is None else 1000 * top[1] // top[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def found(words_of_texts):
    return [runs for runs, _ in pr.collapsed([" ".join(ws).encode() for ws in words_of_texts])]


def test_registered_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted(plain_row(r.doc_id, r.text) for r in docs)
    assert sorted(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).collect()) == want
    assert sum(w[1] > 0 for w in want) >= 15


@pytest.mark.parametrize("seed", range(30))
def test_made_words(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        ws = []
        while len(ws) < rng.choice([10, 120, 500]):
            period = [rng.choice("abcdef"[: rng.randint(1, 6)]) for _ in range(rng.choice([1, 2, 5, 11, 12, 13, 14, 19, 20, 28, 29, 40, 43, 61, 90]))]
            if rng.random() < 0.3 and len(period) > 3:  # a period that nearly repeats in itself
                period = period[: len(period) // 2] * 2 + [rng.choice("abcdef")]
            length = rng.choice([3, 20, 24, int(3 * len(period)), 3 * len(period) - 1, int(3.6 * len(period)), 5 * len(period)])
            ws += [period[i % len(period)] for i in range(length)] + [rng.choice("xyz") for _ in range(rng.randint(0, 4))]
        texts.append(ws)
    assert found(texts) == [plain_runs(ws) for ws in texts]


def test_every_period_is_found_at_its_least_length():
    texts = [[f"w{i % q}" for i in range(max(24, 3 * q))] for q in range(1, 240)]
    texts = [["a", *ws, "b"] for ws in texts]
    assert found(texts) == [[(1, max(24, 3 * q), q)] for q in range(1, 240)]
    assert found([ws[1:-2] for ws in texts[8:]]) == [[]] * 231


def test_scales_cover_all_periods():
    got = [(q, block, width) for low, block, width in pr.scales(5000) for q in range(low, block + 1)]
    assert [q for q, _, _ in got][: 5000 - pr.DIRECT] == list(range(pr.DIRECT + 1, 5001))
    assert all(q <= block and width + block <= 2 * q + 1 and width >= 1 for q, block, width in got)


def test_odd_rows(spark):
    run = " ".join(["é", "b"] * 20)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, run), (4, run), (None, run), (5, "w x " * 30), (6, " ".join(f"w{i % 40000}" for i in range(130000)))]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, runs int")
    got = {(r.doc_id, tuple(map(tuple, r.runs)), r.collapsed if len(r.collapsed) < 100 else len(r.collapsed.split())) for r in pr.collapse_runs(frame).collect()}
    whole = ((0, 40, 2),)
    assert got == {(1, (), ""), (2, (), ""), (3, (), ""), (4, whole, "é b"), (None, whole, "é b"), (5, ((0, 30, 1),), "w x"), (6, ((0, 130000, 40000),), 40000)}
    assert pr.collapse_runs(frame).count() == 8 and pr.collapse_runs(frame.limit(0)).count() == 0
    plain = {r.doc_id: r for r in pr.run_digests(frame).collect()}
    assert (plain[4].n_runs, plain[4].exponent_milli, plain[1].n_runs, plain[1].start) == (1, 20000, 0, None)
    assert plain[6].exponent_milli == 3250 and plain[None].runs_sha256 == plain[4].runs_sha256


def test_reach_backwards_and_over_chunks():
    a = np.array(list(range(100)) * 4 + [-1], np.int32)
    assert pr._reach(a, 0, 100, 1) == 300 and pr._reach(a, 250, 350, -1) == 251 and pr._reach(a, 5, 106, 1) == 0
