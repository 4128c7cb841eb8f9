"""The label model against plain loops, and what becomes a voter."""

import math
import random

import numpy as np

from strandframe.llm import toxicity as T


def plain_model(votes, labels, blocks, prior, rounds=25):
    n, toxic = len(votes), sum(labels)
    clear = [1.0] * n
    for b in sorted(set(blocks)):
        cols = [j for j, x in enumerate(blocks) if x == b]
        v = [[row[j] for j in cols] for row in votes]
        k = range(len(cols))
        hit = lambda w, j: sum(w[i] * v[i][j] for i in range(n))
        flip = [1 - y for y in labels]
        a0, b0 = [(hit(labels, j) + 0.5) / (toxic + 1) for j in k], [(hit(flip, j) + 0.5) / (n - toxic + 1) for j in k]
        right = [(hit(labels, j) + 2 * prior) / (hit([1] * n, j) + 2) for j in k]
        p = [max(v[i][j] * right[j] for j in k) for i in range(n)]
        for _ in range(rounds):
            s, rest = sum(p), [1 - x for x in p]
            a = [(hit(p, j) + a0[j] * n * prior) / (s + n * prior) for j in k]
            q = [(hit(rest, j) + b0[j] * n * (1 - prior)) / (n - s + n * (1 - prior)) for j in k]
            left = [[v[i][j] - p[i] * a[j] - rest[i] * q[j] for j in k] for i in range(n) if any(v[i])]
            size = [math.sqrt(sum(r[j] ** 2 for r in left)) + 1e-9 for j in k]
            weight = [1 / max(1, sum(min(1, max(0, sum(r[j] * r[m] for r in left) / size[j] / size[m])) for m in k)) for j in k]
            logit = [math.log(prior / (1 - prior)) + sum(weight[j] * math.log(a[j] / q[j]) for j in k if v[i][j]) for i in range(n)]
            new = [1 / (1 + math.exp(-max(-30, min(30, x)))) if any(v[i]) else 0.0 for i, x in enumerate(logit)]
            done = max(abs(x - y) for x, y in zip(new, p)) < 1e-4
            p = new
            if done:
                break
        clear = [c * (1 - x) for c, x in zip(clear, p)]
    return [1 - c for c in clear]


def test_label_model_against_loops():
    for seed in range(5):
        rng = random.Random(seed)
        labels = [int(rng.random() < 0.3) for _ in range(60)]
        votes = [[int(rng.random() < (0.6 if y else 0.1)) for _ in range(7)] for y in labels]
        blocks = [0, 0, 0, 1, 1, 2, 2]
        got = T.label_model(np.array(votes), np.array(labels), np.array(blocks), 0.3)
        assert np.allclose(got, plain_model(votes, labels, blocks, 0.3), atol=1e-6)


def test_a_silent_block_does_not_vote():
    """Two families of voters that never meet: both kinds of toxic rows are found."""
    votes = np.array([[1, 1, 0, 0]] * 20 + [[0, 0, 1, 1]] * 5 + [[0, 0, 0, 0]] * 75)
    labels = np.array([1] * 25 + [0] * 75)
    assert T.voter_blocks(votes.astype(np.float32)) == [0, 0, 1, 1]
    p = T.label_model(votes, labels, np.array([0, 0, 1, 1]), 0.25)
    assert (p[:25] > 0.9).all() and (p[25:] == 0).all()


def test_terms_and_votes():
    assert {"lose", "loser", "lose*", "loser*", "lose**"} <= T.terms_of({"lose", "loser"}) and "loser**" not in T.terms_of({"lose", "loser"})
    lexicon = T.Lexicon(["loser", "abcd**", "xyz"], [0, 1, 0])
    assert lexicon.votes("LOSER, loser abcde abcde-xyz z") == ([0, 2], {0: 3, 1: 2}, 5)
    assert lexicon.votes("abcde abcdf")[0] == [1] and lexicon.votes("") == ([], {}, 0)


def test_stems_stay_only_where_they_add():
    y = np.array([1] * 60 + [0] * 300)
    found = [[0, 1]] * 40 + [[0]] * 20 + [[2]] * 20 + [[]] * 280
    assert T.choose_terms(["idio*", "idiot", "idio**"], found, y) == ["idio*"]
    assert T.choose_terms(["idiot", "idio*"], [[0, 1]] * 30 + [[1]] * 30 + [[]] * 300, y) == ["idiot", "idio*"]


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "idiot " * 3), (2, None), (None, "idiot"), (3, "w " * 200000), (1, "x")], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1), (None, 1), (3, 1)], "doc_id long, toxic int")  # labels of one class, and a null id
    got = T.toxicity(docs.withColumn("label", T.F.lit(1)).withColumn("_k", T.F.lit("x")), one).collect()
    assert len(got) == 5 and {r.predicted for r in got} == {0}
    rows = [(i, ("you idiot loser fool " if i % 4 == 0 else "kind words here ") + f"a{i} b{i} c{i} d{i} e{i}") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = T.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got)
    kept = T.reject_toxic(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert kept.count() == 300
