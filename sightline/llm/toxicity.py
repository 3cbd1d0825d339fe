"""Toxicity: nearest labelled examples by exact TF-IDF cosine.

Terms are a text's lower-cased words and their first three to six letters (of a
word of more than ``LONG_WORD`` letters, such as a line in a script without
spaces, all runs of three and four).  The vocabulary is what tells the classes
apart: terms of at least ``MIN_ROWS`` training rows with a chi-squared of at least
``MIN_CHI2``, at most ``MAX_TERMS`` of them, counted over the training sample by
Spark.

The index holds inverted lists of the sample's vectors, which lie in blocks of
``BLOCK`` similar rows; for each term the largest weight in each block is known.  A
text's bound for a block is its weights times those maxima.  The blocks of the
``OPEN_FIRST`` largest bounds are opened first, then all others whose bound is not
below the ``k``-th cosine found there, so the neighbours are exact.

Neighbours vote by 1 / (distance + ``NEAR``).  The votes become probabilities by
isotonic regression over the sample's leave-one-out votes (made in Spark
tasks).  The neighbours, with their cosines and labels, are the evidence.

Training is on a bounded sample (``max_train_rows`` labelled rows, drawn by a
hash of doc_id); all rows are scored, each whole text, without a shuffle.

Defined results: a null or empty text, or one without a term of the vocabulary,
has the share of label 1 among such training rows; without labels every score is
0.5, with labels of one class all scores are near that class's label; of labels of one doc_id
the largest counts, of texts of one doc_id the smallest is learned from; equal
cosines go by the index's order; repeated rows score alike; other columns stay
unless named like an output.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import crc_fold, discard, prepare, worker_cache, written

MAX_TRAIN_ROWS = 10_000
MAX_TERMS, MIN_ROWS, MIN_CHI2 = 4_096, 5, 20.0
NEIGHBOURS, NEAR = 15, 0.05
COUNT_TERMS = 100_000  # counted by a task before they go to the shuffle
BLOCK = 128
OPEN_FIRST = 4
LONG_WORD, BEGINNINGS = 24, (3, 4, 5, 6)
HELD_OUT_FOLDS, HELD_OUT_FOLD = 4, 2
TOXIC_SCORE = 0.3
_WORD = re.compile(r"\w+")
_DIGITS = 12  # cosines are compared after rounding, so that the order of sums doesn't matter


def long_terms(word: str) -> set[str]:
    """The terms of a word of more than ``LONG_WORD`` letters: its runs of letters."""
    return {word[a:a + n] for n in (3, 4) for a in range(len(word) - n + 1)}


def term_set(text: str | None) -> set[str]:
    """The distinct terms of a text."""
    words = set(_WORD.findall(text.lower())) if text else set()
    long = {w for w in words if len(w) > LONG_WORD}
    words -= long
    out = set().union(words, *map(long_terms, long))
    for n in BEGINNINGS:
        out |= {"^" + w[:n] for w in words if len(w) > n}
    return out


class Vocabulary:
    """The chosen terms, numbered, with their idf."""

    def __init__(self, names: list[str], idf: np.ndarray):
        self.number = {t: i for i, t in enumerate(names)}
        self.idf = idf
        # most words have no chosen term: their first letters tell
        self.first = {t[1:4] if t[0] == "^" else t[:3] for t in names}

    def counts(self, text: str | None) -> dict[int, int]:
        """How often each chosen term is in a text."""
        out: dict[int, int] = {}
        number, first = self.number, self.first
        for word, n in Counter(_WORD.findall(text.lower())).items() if text else ():
            if len(word) > LONG_WORD:
                terms = long_terms(word)
            elif word[:3] in first:
                terms = [word, *["^" + word[:k] for k in BEGINNINGS if len(word) > k]]
            else:
                continue
            for term in terms:
                i = number.get(term)
                if i is not None:
                    out[i] = out.get(i, 0) + n
        return out

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers, ascending, and TF-IDF weights of unit length."""
        counts = sorted(self.counts(text).items())
        terms = np.array([i for i, _ in counts], np.int64)
        weights = (1 + np.log(np.array([n for _, n in counts], np.float64))) * self.idf[terms]
        return terms, weights / max(np.sqrt((weights ** 2).sum()), 1e-300)


class BlockMaxIndex:
    """Inverted lists over vectors in blocks of similar ones, with the largest
    weight of each term in each block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: list[int], labels: list[float], terms: int):
        # rows of one class whose heaviest terms agree lie together
        key = lambda i: (labels[i], vectors[i][0][np.argsort(-vectors[i][1], kind="stable")[:3]].tolist(), ids[i])
        order = sorted(range(len(vectors)), key=key)
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.labels = np.array([labels[i] for i in order], np.float64)
        self.n_blocks = -(-len(order) // BLOCK)
        term = np.concatenate([vectors[i][0] for i in order] or [np.zeros(0, np.int64)])
        weight = np.concatenate([vectors[i][1] for i in order] or [np.zeros(0)])
        row = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        self.largest = np.zeros((terms, self.n_blocks))
        np.maximum.at(self.largest, (term, row // BLOCK), weight)
        by_term = np.lexsort((row, term))
        self.row, self.weight = row[by_term], weight[by_term]
        # a term's list in block b is from start[term, b] to start[term, b + 1]
        cells = term[by_term] * self.n_blocks + self.row // BLOCK
        starts = np.searchsorted(cells, np.arange(terms * self.n_blocks + 1)).astype(np.int32)
        self.start = np.concatenate([starts[:-1].reshape(terms, self.n_blocks), starts[self.n_blocks::self.n_blocks, None]],
                                    axis=1) if self.n_blocks else np.zeros((terms, 1), np.int64)

    def _open(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the blocks' rows with a common term."""
        if len(blocks) <= OPEN_FIRST:  # a slice for each term and block
            cuts = [(s, e, w) for t, w in zip(terms, weights) for b in blocks
                    if (s := self.start[t, b]) < (e := self.start[t, b + 1])]
        else:  # whole lists, of which the other blocks' rows are dropped
            cuts = [(self.start[t, 0], self.start[t, -1], w) for t, w in zip(terms, weights)]
        if not cuts:
            return np.zeros(0, np.int64), np.zeros(0)
        rows = np.concatenate([self.row[s:e] for s, e, _ in cuts])
        products = np.concatenate([self.weight[s:e] * w for s, e, w in cuts])
        if len(blocks) > OPEN_FIRST:
            wanted = np.zeros(self.n_blocks, bool)
            wanted[blocks] = True
            keep = wanted[rows // BLOCK]
            rows, products = rows[keep], products[keep]
        sums = np.bincount(rows, products, len(self.ids))
        at = np.flatnonzero(sums)
        return at, np.round(sums[at], _DIGITS)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None):
        """(rows, cosines) of the ``k`` nearest with a common term; the row with the
        id ``without`` is left out."""
        at, cosine = np.zeros(0, np.int64), np.zeros(0)
        if not len(terms) or not self.n_blocks:
            return at, cosine
        bounds = weights @ self.largest[terms]
        order = np.argsort(-bounds, kind="stable")
        for blocks in (order[:OPEN_FIRST], order[OPEN_FIRST:]):
            # rounding may lift a cosine to its bound
            floor = cosine[k - 1] - 10.0 ** -_DIGITS if len(cosine) >= k else 0.0
            blocks = blocks[bounds[blocks] > floor]
            if not len(blocks):
                break
            more, found = self._open(terms, weights, blocks)
            if without is not None:
                other = self.ids[more] != without
                more, found = more[other], found[other]
            at, cosine = np.concatenate([at, more]), np.concatenate([cosine, found])
            top = np.lexsort((at, -cosine))[:k]
            at, cosine = at[top], cosine[top]
        return at, cosine


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function nearest to ``labels`` over ``votes``, as knots; a
    row of each class is added at the ends, so that no score is 0 or 1."""
    votes = np.concatenate([[0.0], votes, [1.0]])
    labels = np.concatenate([[0.0], labels, [1.0]])
    order = np.argsort(votes, kind="stable")
    at, start = np.unique(votes[order], return_index=True)
    sums = np.add.reduceat(labels[order], start)
    pools: list[list[float]] = []  # sum, rows, first knot
    for i, (s, n) in enumerate(zip(sums, np.diff([*start, len(order)]))):
        pools.append([s, n, i])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, n2, _ = pools.pop()
            pools[-1][0] += s2
            pools[-1][1] += n2
    value = np.empty(len(at))
    for (s, n, i), end in zip(pools, [*[p[2] for p in pools[1:]], len(at)]):
        value[i:end] = (s + 0.01) / (n + 0.02)
    return at, np.clip(value, 0.0, 1.0)


@dataclass
class Model:
    vocabulary: Vocabulary
    index: BlockMaxIndex
    knots: np.ndarray
    values: np.ndarray
    without_terms: float
    prior: float

    def vote(self, terms: np.ndarray, weights: np.ndarray, without: int | None = None, k: int = NEIGHBOURS):
        """(vote or None, rows, cosines): the neighbours' weighted vote."""
        at, cosine = self.index.nearest(terms, weights, k, without)
        if not len(at):
            return None, at, cosine
        # the prior speaks with the weight of one far row
        weight, far = 1 / (np.maximum(1 - cosine, 0) + NEAR), 1 / (1 + NEAR)
        return float((weight @ self.index.labels[at] + far * self.prior) / (weight.sum() + far)), at, cosine

    def score(self, text: str | None):
        vote, at, cosine = self.vote(*self.vocabulary.vector(text))
        score = self.without_terms if vote is None else float(np.interp(vote, self.knots, self.values))
        return score, at, cosine


def training_sample(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(doc_id, y, text): about ``max_train_rows`` labelled documents, one row each,
    written.  ``labels`` has doc_id and toxic; the sample's ids are broadcast."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    n = known.count()
    whole = 1 << 62  # a range in which no share rounds to zero
    below = whole if n <= max_train_rows else max(1, max_train_rows * whole // n)
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < below)
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return written(chosen, "toxicity-sample")


def choose_terms(sample: DataFrame, rows: int, positive: int) -> Vocabulary:
    """The terms by chi-squared, from each task's counts summed in Spark."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("toxicity")
        having: tuple[Counter, Counter] = (Counter(), Counter())

        def counts() -> pd.DataFrame:
            terms = list(having[0].keys() | having[1].keys())
            out = pd.DataFrame({"term": terms, "n": [having[0][t] + having[1][t] for t in terms],
                                "a": [having[1][t] for t in terms]})
            for h in having:
                h.clear()
            return out

        for b in batches:
            for y, text in zip(b["y"], b["text"]):
                having[y].update(term_set(text))
                if len(having[0]) + len(having[1]) >= COUNT_TERMS:
                    yield counts()
        if having[0] or having[1]:
            yield counts()

    counted = sample.mapInPandas(count, "term string, n long, a long").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("a").alias("a")).where(F.col("n") >= MIN_ROWS)
    n, a = F.col("n").cast("double"), F.col("a").cast("double")
    gap = a * rows - n * positive
    spread = n * (rows - n) * float(positive) * float(rows - positive)
    chi2 = F.when(spread > 0, gap * gap * rows / spread).otherwise(0.0)
    best = counted.withColumn("chi2", chi2).where(F.col("chi2") >= MIN_CHI2).orderBy(
        F.col("chi2").desc(), "term").limit(MAX_TERMS).collect()
    names = [r["term"] for r in best]
    idf = np.log((1 + rows) / (1 + np.array([r["n"] for r in best], np.float64))) + 1
    return Vocabulary(names, idf)


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Learn from ``labels`` (doc_id, toxic) and the texts of ``docs``."""
    prepare(docs.sparkSession)
    sample = training_sample(docs, labels, max_train_rows)
    n = sample.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("y"), F.lit(0)).alias("positive")).first()
    rows, positive = n["rows"], n["positive"]
    prior = (positive + 0.01) / (rows + 0.02)
    vocabulary = choose_terms(sample, rows, positive)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("toxicity")
        for b in batches:
            found = [vocabulary.vector(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "terms": [t.tobytes() for t, _ in found],
                                "weights": [w.tobytes() for _, w in found]})

    vectors_of = written(sample.mapInPandas(vectors, "doc_id long, y int, terms binary, weights binary"), "toxicity-vectors")
    discard(sample)
    coded = vectors_of.toPandas().sort_values("doc_id")  # the same index whatever the order of tasks
    filled = coded[coded["terms"].str.len() > 0]
    bare = coded[coded["terms"].str.len() == 0]["y"]
    index = BlockMaxIndex([(np.frombuffer(t, np.int64), np.frombuffer(w, np.float64)) for t, w in zip(filled["terms"], filled["weights"])],
                          filled["doc_id"].tolist(), filled["y"].tolist(), len(vocabulary.number))
    model = Model(vocabulary, index, np.array([0.0, 1.0]), np.array([0.0, 1.0]),
                  float((bare.sum() + prior) / (len(bare) + 1)), prior)

    def leave_one_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("toxicity")
        for b in batches:
            votes = [model.vote(np.frombuffer(t, np.int64), np.frombuffer(w, np.float64), without=i)[0]
                     for t, w, i in zip(b["terms"], b["weights"], b["doc_id"])]
            out = pd.DataFrame({"vote": votes, "y": b["y"]}).dropna()
            yield out.astype({"vote": "float64", "y": "int32"})

    votes = vectors_of.repartition(docs.sparkSession.sparkContext.defaultParallelism).mapInPandas(
        leave_one_out, "vote double, y int").toPandas()
    discard(vectors_of)
    model.knots, model.values = isotonic(votes["vote"].to_numpy(np.float64), votes["y"].to_numpy(np.float64))
    return model


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", evidence: bool = False) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1; with ``evidence`` also
    ``neighbours``, an array of (doc_id, cosine, label), nearest first."""
    prepare(docs.sparkSession)
    kind = "score double" + (", ids array<long>, cosines array<double>, labels array<int>" if evidence else "")

    @F.pandas_udf(kind)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker_cache("toxicity")
        for texts in batches:
            found = [model.score(t) for t in texts]
            out = {"score": [s for s, _, _ in found]}
            if evidence:
                out |= {"ids": [model.index.ids[at] for _, at, _ in found], "cosines": [c for _, _, c in found],
                        "labels": [model.index.labels[at].astype(np.int32) for _, at, _ in found]}
            yield pd.DataFrame(out)

    outputs = ["score", *(["neighbours"] if evidence else [])]
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (*outputs, "_found")]
    # else a filter on the score would run the scoring again below itself
    found = docs.select(*keep, score.asNondeterministic()(F.col(f"`{text_col}`")).alias("_found"))
    pairs = F.arrays_zip(F.col("_found.ids").alias("doc_id"), F.col("_found.cosines").alias("cosine"),
                         F.col("_found.labels").alias("label")).alias("neighbours") if evidence else None
    return found.select(*keep, F.col("_found.score").alias("score"), *([pairs] if evidence else []))


def classify(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, evidence: bool = False) -> DataFrame:
    """Learn from the labels outside the held-out fold, score all of ``docs``."""
    learn = labels.where(crc_fold(F.col("doc_id"), HELD_OUT_FOLDS) != HELD_OUT_FOLD)
    model = fit(docs, learn, max_train_rows)
    return (score_toxicity(docs, model, evidence=evidence)
            .withColumn("held_out", crc_fold(F.col("doc_id"), HELD_OUT_FOLDS) == HELD_OUT_FOLD)
            .withColumn("predicted", (F.col("score") >= TOXIC_SCORE).cast("int")))
