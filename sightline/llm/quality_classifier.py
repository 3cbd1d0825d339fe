"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training: a bounded sample of labelled rows (``max_train_rows``, chosen by a
hash of doc_id) gets its statistics in Spark tasks; the statistics alone, some
MB at that bound, come to the driver, where the trees are grown level by level
from gradient histograms over quantile bins.

Scoring: the trees are complete binary trees flattened into three arrays
(feature, threshold, leaf value) and ship with the task.  Every batch of texts
becomes one matrix of statistics, and numpy walks all rows through all trees at
once, one level a step.  Nothing is shuffled, every whole text is scored.

The statistics come from the text alone: no label, language, source or id.

Defined results: a null or empty text has all statistics zero and gets the
score of that row; without labels of both classes every score is the share of
label 1 (0.5 without any); repeated rows score alike, and a doc_id with several
labels or texts is learned from once; other columns are kept
unless named like an output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import crc_fold, prepare
from sightline.llm.quality_rules import stop_word_forms

MAX_TRAIN_ROWS = 20_000
HELD_OUT_FOLDS, HELD_OUT_FOLD = 4, 2
KEEP_SCORE = 0.7
STATISTICS = (
    "log_chars", "log_words", "mean_word", "upper", "digits", "symbols", "bars", "bangs", "stops_commas",
    "spaces", "non_ascii", "distinct_words", "distinct_pairs", "distinct_lines", "stop_words",
    "mean_line", "longest_word", "words_without_letters",
)


def _byte_classes() -> np.ndarray:
    """One row of 256 weights for each counted class of bytes."""
    sets = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!", b".,;:?", b" \t\n\r",
            bytes(range(128, 256))]
    out = np.zeros((len(sets), 256))
    for i, s in enumerate(sets):
        out[i, list(s)] = 1
    return out


_CLASSES = _byte_classes()
_STOPS = frozenset(stop_word_forms())


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    upper, digits, symbols, bars, bangs, points, spaces, high = (
        _CLASSES @ np.bincount(raw, minlength=256) / len(raw))
    words = text.split()
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = list(map(len, words))
    total = sum(lengths)
    return [
        np.log1p(len(text)), np.log1p(len(words)), total / n, upper, digits, symbols, bars, bangs, points,
        spaces, high, len(set(words)) / n, len(set(zip(words, words[1:]))) / n,
        len(set(lines)) / max(len(lines), 1), sum(map(_STOPS.__contains__, words)) / n,
        np.log1p(len(text) / max(len(lines), 1)), np.log1p(max(lengths, default=0)),
        sum(not w[0].isalpha() for w in words) / n,
    ]


def statistics_matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(STATISTICS))


@dataclass
class Trees:
    """Boosted complete binary trees of one depth, flattened: node ``i`` of a
    tree has the children ``2i + 1`` and ``2i + 2``; a row goes right where its
    value is above the threshold."""

    base: float
    feature: np.ndarray    # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    value: np.ndarray      # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        n, trees = len(x), len(self.feature)
        if not n or not trees:
            return np.full(n, 1 / (1 + np.exp(-self.base)))
        node = np.zeros((n, trees), dtype=np.int64)
        rows, tree = np.arange(n)[:, None], np.arange(trees)[None, :]
        inner = self.feature.shape[1]
        while node[0, 0] < inner:
            right = x[rows, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        return 1 / (1 + np.exp(-(self.base + self.value[tree, node - inner].sum(axis=1))))


def grow_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64,
               rate: float = 0.15, l2: float = 1.0, min_rows: int = 20) -> Trees:
    """Histogram gradient boosting for the logistic loss."""
    p = float(y.mean()) if len(y) else 0.5
    base = float(np.log(np.clip(p, 1e-3, 0.999) / np.clip(1 - p, 1e-3, 0.999)))
    inner, leaves, width = 2 ** depth - 1, 2 ** depth, x.shape[1]
    if p in (0.0, 1.0) or not len(y):
        return Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    raw = np.full(len(y), base)
    out = Trees(base, np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    for t in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            best = np.full(count, 1e-6)
            cut = np.full(count, bins, dtype=np.int64)
            feat = np.zeros(count, dtype=np.int64)
            for f in range(width):
                key = (node - first) * bins + binned[f]
                hist = [np.bincount(key, weights=w, minlength=count * bins).reshape(count, bins)
                        for w in (g, h, np.ones_like(g))]
                left = [np.cumsum(a, axis=1) for a in hist]
                total = [a[:, -1:] for a in left]
                gl, hl, nl = left
                gr, hr, nr = (total[i] - left[i] for i in range(3))
                gain = gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - total[0] ** 2 / (total[1] + l2)
                gain[(nl < min_rows) | (nr < min_rows)] = -1
                gain[:, len(edges[f]):] = -1
                at = gain.argmax(axis=1)
                top = gain[np.arange(count), at]
                better = top > best
                best[better], cut[better], feat[better] = top[better], at[better], f
            for k in np.flatnonzero(cut < bins):
                out.feature[t, first + k] = feat[k]
                out.threshold[t, first + k] = edges[feat[k]][cut[k]]
            local = node - first
            node = 2 * node + 1 + (binned[feat[local], np.arange(len(y))] > cut[local])
        leaf = node - inner
        gs, hs = (np.bincount(leaf, weights=w, minlength=leaves) for w in (g, h))
        out.value[t] = -rate * gs / (hs + l2)
        raw = raw + out.value[t][leaf]
    return out


def training_statistics(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS,
                        id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the training sample.  ``labels`` has doc_id and
    quality (0 or 1); the rows to learn from are the caller's choice.  The
    sample's ids are broadcast: about ``max_train_rows`` of them.  Each has one
    row, however many a doc_id has: the largest label and the smallest text."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("quality").alias("quality"))
    n = known.count()
    whole = 1 << 62  # a range in which no share rounds to zero
    below = whole if n <= max_train_rows else max(1, max_train_rows * whole // n)
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < below).select(
        F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
    chosen = docs.select(F.col(f"`{id_col}`").alias("_doc"), F.col(f"`{text_col}`").alias("_text")).join(
        F.broadcast(sample), F.col("_doc") == F.col("_id")).groupBy("_doc", "_y").agg(F.min("_text").alias("_text"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_doc": b["_doc"], "_y": b["_y"], "_x": list(statistics_matrix(b["_text"]))})

    rows = chosen.mapInPandas(measure, "_doc long, _y int, _x array<double>").collect()
    rows.sort(key=lambda r: (r["_doc"], r["_y"]))  # the same trees whatever the order of tasks
    x = np.array([r["_x"] for r in rows]).reshape(-1, len(STATISTICS))
    return x, np.array([float(r["_y"] > 0) for r in rows])


def score_quality(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``: the probability of label 1."""
    prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(statistics_matrix(texts)))

    # else a filter on the score would run the scoring again below itself
    return docs.withColumn("score", score.asNondeterministic()(F.col(f"`{text_col}`")))


def classify(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Learn from the labels outside the held-out fold, score all of ``docs``."""
    prepare(docs.sparkSession)
    learn = labels.where(crc_fold(F.col("doc_id"), HELD_OUT_FOLDS) != HELD_OUT_FOLD)
    model = grow_trees(*training_statistics(docs, learn, max_train_rows))
    scored = score_quality(docs, model)
    return (scored.withColumn("held_out", crc_fold(F.col("doc_id"), HELD_OUT_FOLDS) == HELD_OUT_FOLD)
            .withColumn("predicted", (F.col("score") >= KEEP_SCORE).cast("int")))
