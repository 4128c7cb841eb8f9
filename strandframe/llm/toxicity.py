"""Toxicity by weak supervision.

1. Of the labelled training rows (at most ``MAX_ROWS``, taken in hash order, near copies counted once), words, word stems and
   stems of two different words that mark toxic texts become lexicon voters.  Of a word and its stems the strongest stays; another
   one joins it only if it still marks toxic texts where the stronger ones are silent.
2. Voters that stand in the same texts form a block (the insults of one language, say).  Counts and shares of a block's hits
   are its pattern voters.
3. A generative label model estimates, block by block and by expectation maximisation, how often each voter fires on toxic and on
   clean texts, starting from and held by the labelled rows.  A voter that does not fire abstains.  Voters of a block that
   fire together beyond what the class explains share their weight (conditional correlation).  A text is toxic if any block
   says so (noisy-or).
4. A logistic regression is trained on the model's posterior labels.  The labels also place the 0.5 threshold.
5. Every whole text is scored; nothing but the text enters a score.

Only the bounded training sample is gathered: term counts are summed by Spark, at most ``MAX_TERMS`` candidate terms and a vote
list for each training row reach the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chains import let
from ..session import stored

#: Labelled rows used for fitting, and candidate terms, the strongest first, at most.
MAX_ROWS, MAX_TERMS = 20_000, 2000
#: A term must mark toxic rows this many times as often as clean ones, and by no accident: least log-likelihood ratio.
LIFT, RATIO = 4.0, 15.0
#: Lengths of word stems.
STEMS = range(4, 9)
#: Two voters are in one block if they share so much of the rarer one's rows.
TOGETHER = 0.2
#: Training rows with the same smallest hash of any five words under one of these seeds are copies.
COPY_SEEDS = (1, 2, 3)
#: Pattern voters: hits of a block, and hits in a hundred words.
HITS, SHARES = (1, 2, 3, 5, 8), (0.2, 0.5, 1.0, 2.0, 4.0)
REMEMBERED = 1 << 19
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(token: str) -> list[str]:
    return _LETTERS.findall(token.lower())


def stems_of(word: str) -> list[str]:
    return [word[:n] for n in STEMS if n <= len(word)]


def terms_of(words: set[str]) -> set[str]:
    """Words, their stems marked with a star, and with two stars stems of at least two of the words."""
    stems = Counter(s for w in words for s in stems_of(w))
    return words | {s + "*" for s in stems} | {s + "**" for s, n in stems.items() if n > 1}


class Lexicon(dict):
    """token -> what its words hit: (word, terms, stems that count from two words on, blocks); remembered."""

    def __init__(self, terms: list[str], blocks: list[int] | None = None):
        self.numbers = {t: i for i, t in enumerate(terms)}
        self.blocks = blocks or [0] * len(terms)

    def __missing__(self, token: str) -> tuple:
        if len(self) >= REMEMBERED:
            self.clear()
        out = []
        for w in words_of(token):
            once = [self.numbers[t] for t in (w, *(s + "*" for s in stems_of(w))) if t in self.numbers]
            twice = [self.numbers[t] for t in (s + "**" for s in stems_of(w)) if t in self.numbers]
            if once or twice:
                out.append((w, once, twice, {self.blocks[t] for t in (*once, *twice)}))
        self[token] = tuple(out)
        return self[token]

    def votes(self, text: str) -> tuple[list[int], Counter, int]:
        """Distinct terms of a text, its hits by block, and its words."""
        found, hits, n, seen, pairs = set(), Counter(), 0, set(), Counter()
        for token in text.split():
            n += 1
            for word, once, twice, blocks in self[token]:
                hits.update(blocks)
                if word not in seen:
                    seen.add(word)
                    found.update(once)
                    pairs.update(twice)
        return sorted(found | {t for t, k in pairs.items() if k > 1}), hits, n


def _training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(label, body) of at most ``MAX_ROWS`` labelled rows outside the held-out fold; of near copies the one with the smallest id."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("label"))
    known = known.where(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id").limit(MAX_ROWS)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = rows.join(F.broadcast(known), "_id")  # at most MAX_ROWS small rows
    for seed in COPY_SEEDS:
        rows = rows.groupBy(_sketch(F.col("body"), seed).alias("_k")).agg(F.min(F.struct("_id", "label", "body")).alias("r")).select("r.*")
    return rows.select("label", "body")


def _sketch(body: Column, seed: int) -> Column:
    """The smallest hash of any five words."""
    starts = lambda ws: F.sequence(F.lit(1), F.greatest(F.size(ws) - 4, F.lit(1)))
    return let(F.split(F.trim(body), r"\s+"), lambda ws: F.array_min(F.transform(starts(ws), lambda i: F.xxhash64(F.lit(seed), F.slice(ws, i, 5)))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _count_terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in it:
        for label, body in zip(batch["label"].to_pylist(), batch["body"].to_pylist()):
            seen[label].update(terms_of({w for token in set(body.split()) for w in words_of(token)}))
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield from _flushed(seen)
    yield from _flushed(seen)


def _flushed(seen: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
    for label, counts in seen.items():
        terms, n = pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())
        yield pa.RecordBatch.from_arrays([terms, pa.array([label] * len(n), pa.int64()), n], ["term", "label", "n"])
        counts.clear()


def ratio_of(a: float, b: float, toxic: int, clean: int) -> float:
    """Log-likelihood ratio of a term in ``a`` toxic and ``b`` clean rows; 0 if it doesn't mark toxic ones ``LIFT`` times as often."""
    if (a + 0.5) / (toxic + 1) < LIFT * (b + 0.5) / (clean + 1):
        return 0.0
    n, share = a + b, toxic / (toxic + clean)
    return sum(c * math.log(c / (n * p)) for c, p in ((a, share), (b, 1 - share)) if c)


def candidates(rows: DataFrame, toxic: int, clean: int) -> list[str]:
    """The ``MAX_TERMS`` strongest terms, the strongest first."""
    counted = rows.mapInArrow(_count_terms, "term string, label long, n long").groupBy("term")
    counted = counted.agg(F.sum(F.expr("if(label = 1, n, 0)")).alias("a"), F.sum(F.expr("if(label = 0, n, 0)")).alias("b"))
    lift = (F.col("a") + 0.5) / (toxic + 1) / ((F.col("b") + 0.5) / (clean + 1))
    share = toxic / (toxic + clean)
    n = F.col("a") + F.col("b")
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * p))).otherwise(0.0)
    ratio = part("a", share) + part("b", 1 - share)
    best = counted.where((lift >= LIFT) & (ratio >= RATIO)).orderBy(ratio.desc(), "term").limit(MAX_TERMS)
    return [r.term for r in best.collect()]


def choose_terms(terms: list[str], found: list[list[int]], y: np.ndarray) -> list[str]:
    """Of terms, the strongest first, those that mark toxic rows where no stronger one with the same beginning fires."""
    rows: list[set[int]] = [set() for _ in terms]
    for i, own in enumerate(found):
        for t in own:
            rows[t].add(i)
    toxic, clean = int(y.sum()), int(len(y) - y.sum())
    kept: list[int] = []
    for t, term in enumerate(terms):
        stem = term.rstrip("*")
        kin = [k for k in kept if terms[k].startswith(stem) or stem.startswith(terms[k].rstrip("*"))]
        rest = rows[t].difference(*(rows[k] for k in kin))
        a = int(sum(y[i] for i in rest))
        if ratio_of(a, len(rest) - a, toxic, clean) >= RATIO:
            kept.append(t)
    return [terms[t] for t in kept]


def voter_blocks(x: np.ndarray) -> list[int]:
    """For each voter (a 0/1 column) the number of its block: voters linked by sharing ``TOGETHER`` of the rarer one's rows."""
    both, n = x.T @ x, x.sum(0)
    linked = both >= TOGETHER * np.maximum(np.minimum(n[:, None], n[None, :]), 1)
    block, blocks = [-1] * len(n), 0
    for first in range(len(n)):
        if block[first] < 0:
            queue, block[first] = [first], blocks
            for v in queue:
                for w in np.flatnonzero(linked[v]):
                    if block[w] < 0:
                        block[w] = blocks
                        queue.append(int(w))
            blocks += 1
    return block


def features(found: list[int], hits: dict[int, int], n: int, terms: int, blocks: int) -> np.ndarray:
    """Votes of one text: a 0/1 for each term, then for the patterns of each block."""
    width = len(HITS) + len(SHARES)
    out = np.zeros(terms + blocks * width, np.float32)
    out[found] = 1
    for b, k in hits.items():
        share = 100 * k / max(n, 1)
        out[terms + b * width : terms + (b + 1) * width] = [k >= h for h in HITS] + [share >= s for s in SHARES]
    return out


def label_model(votes: np.ndarray, labels: np.ndarray, blocks: np.ndarray, prior: float, rounds: int = 25) -> np.ndarray:
    """Posterior of the toxic class for each row; ``blocks`` has the block of each voter (column).

    In a block, rows on which no voter fires are clean.  The others start from the best precision of their firing voters on
    the labelled rows.  Rates of firing are those of the posterior, averaged with those of the labels.
    """
    n, toxic = len(votes), float(labels.sum())
    clear = np.ones(n)
    for b in np.unique(blocks):
        v = votes[:, blocks == b].astype(np.float64)
        active = v.any(axis=1)
        a0, b0 = (labels @ v + 0.5) / (toxic + 1), ((1 - labels) @ v + 0.5) / (n - toxic + 1)
        precision = (labels @ v + 2 * prior) / (v.sum(axis=0) + 2)
        p = (v * precision).max(axis=1)
        for _ in range(rounds):
            a = (p @ v + a0 * n * prior) / (p.sum() + n * prior)
            q = ((1 - p) @ v + b0 * n * (1 - prior)) / (n - p.sum() + n * (1 - prior))
            left = (v - np.outer(p, a) - np.outer(1 - p, q))[active]
            spread = np.sqrt((left**2).sum(axis=0)) + 1e-9
            together = np.clip((left.T @ left) / np.outer(spread, spread), 0, 1)
            weight = 1 / np.maximum(together.sum(axis=0), 1)
            logit = math.log(prior / (1 - prior)) + v @ (weight * np.log(a / q))
            new = np.where(active, 1 / (1 + np.exp(-np.clip(logit, -30, 30))), 0)
            done = np.abs(new - p).max(initial=0) < 1e-4
            p = new
            if done:
                break
        clear *= 1 - p
    return 1 - clear


def linear_model(x: np.ndarray, target: np.ndarray, penalty: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(x1.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        hess = (x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + np.diag(ridge)
        w -= np.linalg.solve(hess, x1.T @ (p - target) + ridge * w)
    return w[:-1], float(w[-1])


def best_shift(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit that separates the labels with the largest F1; the middle of the gap around it."""
    order = np.argsort(-logits, kind="stable")
    hit = np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + labels.sum())
    ends = np.append(logits[order][1:] < logits[order][:-1], True)
    at = int(np.argmax(np.where(ends, f1, -1)))
    low = logits[order][at + 1] if at + 1 < len(order) else logits[order][at] - 1
    return float((logits[order][at] + low) / 2)


class Model:
    """Terms and their blocks, weights and intercept; a constant without terms."""

    def __init__(self, terms: list[str], blocks: list[int], weights: np.ndarray, intercept: float):
        self.terms, self.blocks, self.weights, self.intercept = terms, blocks, weights, intercept

    def score(self) -> Column:
        terms, blocks, weights, intercept = self.terms, self.blocks, self.weights, self.intercept
        n = max(blocks, default=-1) + 1

        @F.pandas_udf(T.DoubleType())
        def of(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            lexicon = Lexicon(terms, blocks)
            for s in it:
                logits = [intercept + (float(features(*lexicon.votes(x or ""), len(terms), n) @ weights) if terms else 0.0) for x in s]
                yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(logits, float), -30, 30))), dtype="float64")

        return of


def _votes(rows: DataFrame, terms: list[str], blocks: list[int] | None = None) -> list:
    """label, found, hits (block -> number) and n of the training rows, which are at most ``MAX_ROWS``."""

    def vote(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(terms, blocks)
        for pdf in it:
            got = [lexicon.votes(x) for x in pdf["body"]]
            yield pd.DataFrame({"label": pdf["label"], "found": [g[0] for g in got], "hits": [dict(g[1]) for g in got], "n": [g[2] for g in got]})

    return rows.mapInPandas(vote, "label int, found array<int>, hits map<int,int>, n int").collect()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model; without toxic or clean training rows, or without a telling term, a constant below 0.5."""
    rows = stored(_training(docs, labels, id_col, text_col))
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    prior = min(0.49, (toxic + 0.5) / (toxic + clean + 2))
    constant = Model([], [], np.zeros(0), float(np.log(prior / (1 - prior))))
    terms = candidates(rows, toxic, clean) if toxic and clean else []
    if not terms:
        return constant
    first = _votes(rows, terms)
    terms = choose_terms(terms, [r.found for r in first], np.array([r.label for r in first]))
    single = np.zeros((len(first), len(terms)), np.float32)
    voted = _votes(rows, terms)
    for i, r in enumerate(voted):
        single[i, r.found] = 1
    blocks = voter_blocks(single)
    n_blocks = max(blocks) + 1
    voted = _votes(rows, terms, blocks)
    x = np.stack([features(r.found, r.hits, r.n, len(terms), n_blocks) for r in voted])
    y = np.array([r.label for r in voted])
    owner = np.concatenate([blocks, np.repeat(np.arange(n_blocks), len(HITS) + len(SHARES))])
    weights, intercept = linear_model(x, label_model(x, y, owner, prior))
    return Model(terms, blocks, weights, intercept - best_shift(x @ weights + intercept, y))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    A null text scores as an empty one, which no voter votes on.  Rows with a null id are never held out and never
    train.  Several labels of one id count as toxic if any is.  Equal texts score alike; other columns are ignored.
    """
    model = fit(docs, labels, id_col, text_col)
    out = docs.select(F.col(id_col).alias("_id"), model.score()(F.coalesce(F.col(text_col), F.lit(""))).alias("score"))
    return out.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below 0.5."""
    return docs.where(fit(docs, labels, id_col, text_col).score()(F.coalesce(docs[text_col], F.lit(""))) < 0.5)
