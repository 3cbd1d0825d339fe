"""Language ID: a linear-chain conditional random field over words.

Each white-space word with a letter is one position; its potentials are sums of
learned weights of its affixes (up to four letters with the word edge), its
letter bigrams and trigrams, and of itself if it is in the learned lexicon.
A longer word than ``PIECE`` letters (a line in a script without spaces) is cut
into about equal pieces, each a position of its own: every letter counts.
Transitions between the languages of neighbouring words are learned too, so
that single odd words don't switch the language while runs do.

Training: a bounded sample of the distinct labelled texts of each language (by a
hash of the text; about ``max_train_rows`` together, of which every language may
have as many as another, and ``MIN_LANGUAGE_ROWS`` in any case; from each at most
``TRAIN_CHUNKS`` chunks of ``CHUNK`` words, spread evenly over the whole text)
comes to the driver; full-batch gradient ascent of
the conditional likelihood, with forward-backward over all chunks at once.

Labelling: each batch of whole texts is one forward-backward run, vectorised
over documents (sorted by length, so that the active ones are a prefix).  A
position's potentials are computed once and kept by a bounded cache.  A document's
language is the one with the largest sum of its positions' marginals; its score is that
sum's share.  Only counts and the training sample are shuffled.

Defined results: null texts and texts without a letter are ``und`` with score
0; without training rows every text is; repeated rows are labelled alike;
input columns stay unless named like an output; of languages with equal sums the
first by name wins; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import crc_fold, prepare, worker_cache

HELD_OUT_FOLDS, HELD_OUT_FOLD = 3, 1
MAX_TRAIN_ROWS = 1_500
MIN_LANGUAGE_ROWS = 100
_RANGE = 1 << 62  # of the hashes that draw the sample
CHUNK, TRAIN_CHUNKS = 64, 6
TABLE_BITS = 17
LEXICON_MIN = 5
CACHE_WORDS = 400_000
BLOCK_WORDS = 4_096
GROUP_CHARS = 4 << 20
UNKNOWN = "und"
PIECE = 24
_INNER = " "  # an end of a piece that isn't the word's; no word holds it
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letters_of(word: str) -> str:
    """A word's letters, lower-cased."""
    word = word.lower()
    return word if word.isalpha() else _NOT_LETTERS.sub("", word)


def word_pieces(core: str) -> list[str]:
    """The positions of a word's letters: itself, or pieces of at most ``PIECE``
    letters and edges that overlap by two, so that each trigram is in one."""
    if len(core) <= PIECE:
        return [core] if core else []
    size = len(core)  # and two edges, of which the overlap takes as many
    step = -(-size // -(-size // PIECE))
    marked = f"^{core}$"
    parts = [marked[a:a + step + 2] for a in range(0, size, step)]
    return [parts[0][1:] + _INNER, *[_INNER + p + _INNER for p in parts[1:-1]], _INNER + parts[-1][:-1]]


def positions_of(text: str | None) -> list[str]:
    """The white-space words of ``text``, long ones as pieces."""
    words = text.split() if text else []
    if max(map(len, words), default=0) > PIECE:
        words = [p for w in words for p in (word_pieces(letters_of(w)) if len(w) > PIECE else (w,))]
    return words


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h + np.uint64(seed)) * _MIX
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of ``^word$``, zero-padded; no sign at a piece's inner ends."""
    marked = [f"^{w}$" if _INNER not in w else
              ("" if w[0] == _INNER else "^") + w.strip(_INNER) + ("" if w[-1] == _INNER else "$") for w in words]
    width = max(PIECE + 2, max(map(len, marked), default=0))
    return np.array(marked, dtype=f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint64)


def word_keys(words: list[str]) -> np.ndarray:
    """A 64-bit key of each word, for the lexicon."""
    codes, key = _codes(words), np.zeros(len(words), np.uint64)
    for i in range(codes.shape[1]):
        key = np.where(codes[:, i] > 0, key * np.uint64(0x100000001B3) + codes[:, i], key)
    return _mixed(key, 7)


def word_features(words: list[str]) -> np.ndarray:
    """Feature numbers of each word (words x slots); 0 is no feature."""
    codes = _codes(words)
    n, width = codes.shape
    last = (codes != 0).sum(axis=1)
    slots = []

    def gram(start: np.ndarray | int, size: int, seed: int, ok: np.ndarray) -> None:
        h = np.zeros(n, np.uint64)
        rows = np.arange(n)
        for k in range(size):
            at = start + k
            h = h * np.uint64(0x100000001B3) + (codes[rows, np.clip(at, 0, width - 1)] if not np.isscalar(at) else codes[:, at])
        f = (_mixed(h, seed) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
        slots.append(np.where(ok, np.maximum(f, 1), 0))

    for size in (4, 5):  # affixes with the edge; shorter ones are among the n-grams
        gram(0, size, 100 + size, last >= size)
        gram(last - size, size, 200 + size, last >= size)
    longest = int(last.max(initial=0))
    for size in (2, 3):
        for i in range(max(longest - size + 1, 0)):
            gram(i, size, size, last >= i + size)
    return np.stack(slots, axis=1) if slots else np.zeros((n, 0), np.int32)


def _ragged(ids: list[np.ndarray]):
    """Time-major layout of sequences: the longest first, positions grouped by
    step.  Returns (order of sequences, ids by step, step offsets)."""
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    steps = int(lengths.max(initial=0))
    active = np.searchsorted(-lengths[order], -np.arange(1, steps + 1), side="right")
    flat = np.concatenate([ids[i] for i in order]) if len(ids) else np.zeros(0, np.int64)
    t = np.concatenate([np.arange(lengths[i]) for i in order]) if len(ids) else flat
    return order, flat[np.argsort(t, kind="stable")], np.concatenate([[0], np.cumsum(active)])


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray      # table x languages; row 0 is zero
    transitions: np.ndarray  # from x to
    start: np.ndarray
    lexicon: np.ndarray      # sorted word keys
    lexicon_weights: np.ndarray

    def potentials(self, words: list[str]) -> np.ndarray:
        """Log potentials (words x languages)."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for a in range(0, len(words), 20_000):
            part = words[a:a + 20_000]
            for slot in word_features(part).T:
                out[a:a + len(part)] += self.weights[slot]
            if len(self.lexicon):
                key = word_keys(part)
                at = np.minimum(np.searchsorted(self.lexicon, key), len(self.lexicon) - 1)
                out[a:a + len(part)] += self.lexicon_weights[at] * (self.lexicon[at] == key)[:, None]
        return out

    def marginals(self, phi: np.ndarray, rows: np.ndarray, offsets: np.ndarray, pairs: bool = False):
        """Forward-backward over a time-major layout; ``phi`` are potentials
        (not logs) of words and ``rows`` the word of each position."""
        move, first = np.exp(self.transitions), np.exp(self.start)
        move, first = (move / move.max()).astype(np.float32), (first / first.max()).astype(np.float32)
        steps = len(offsets) - 1
        alpha = phi[rows]
        scale = np.empty(len(rows), np.float32)
        for t in range(steps):
            a, b = offsets[t], offsets[t + 1]
            now = alpha[a:b]
            now *= first if t == 0 else alpha[offsets[t - 1]:offsets[t - 1] + b - a] @ move
            s = now.sum(axis=1)
            scale[a:b] = s
            now /= s[:, None]
        expected = np.zeros_like(move)
        beta = np.ones((int(offsets[1]) if steps else 0, len(first)), np.float32)
        for t in range(steps - 1, -1, -1):
            a, b = offsets[t], offsets[t + 1]
            if t < steps - 1:
                n = offsets[t + 2] - b
                come = phi[rows[b:b + n]] * beta[:n] / scale[b:b + n][:, None]
                if pairs:
                    expected += move * (alpha[a:a + n].T @ come)
                beta[:n] = come @ move.T
            gamma = alpha[a:b] * beta[:b - a]
            # the forward values of this step aren't needed again: keep the marginals there
            alpha[a:b] = gamma / gamma.sum(axis=1, keepdims=True)
        return (alpha, expected) if pairs else alpha


def train_crf(samples: list[tuple[str, list[str]]], rounds: int = 30, rate: float = 0.3, l2: float = 1e-6) -> Crf:
    """Fit to (language, words) chunks by full-batch AdaGrad."""
    languages = sorted({lang for lang, _ in samples})
    size = len(languages)
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in ws], dtype=np.int64) for _, ws in samples]
    words = list(vocab)
    crf = Crf(languages, np.zeros((1 << TABLE_BITS, size), np.float32), np.zeros((size, size)), np.zeros(size),
              np.zeros(0, np.uint64), np.zeros((0, size), np.float32))
    if not size:
        return crf
    label = np.array([languages.index(lang) for lang, _ in samples])
    del samples
    order, rows, offsets = _ragged(ids)
    gold = np.concatenate([label[order][:offsets[t + 1] - offsets[t]] for t in range(len(offsets) - 1)])
    counts = np.bincount(rows, minlength=len(words))
    keys = word_keys(words)
    crf.lexicon = np.sort(keys[counts >= LEXICON_MIN])
    crf.lexicon_weights = np.zeros((len(crf.lexicon), size), np.float32)
    slot = np.searchsorted(crf.lexicon, keys)
    in_lexicon = counts >= LEXICON_MIN
    blocks = _feature_blocks(words)
    true = np.zeros((len(words), size))
    np.add.at(true, (rows, gold), 1)
    pairs_true = np.zeros((size, size))
    for a, b in zip(offsets[1:], offsets[2:]):
        pairs_true[np.arange(size), np.arange(size)] += np.bincount(gold[a:b], minlength=size)
    start_true = np.bincount(label, minlength=size)
    memory = [np.full(x.shape, 1e-2) for x in (crf.weights, crf.lexicon_weights, crf.transitions, crf.start)]
    total = len(rows)
    for _ in range(rounds):
        log = np.empty((len(words), size), np.float32)
        for at, feats in blocks:
            log[at] = crf.weights[feats].sum(axis=1)
        log[in_lexicon] += crf.lexicon_weights[slot[in_lexicon]]
        phi = np.exp(log - log.max(axis=1, keepdims=True)).astype(np.float32)
        marg, pairs = crf.marginals(phi, rows, offsets, pairs=True)
        soft = np.stack([np.bincount(rows, weights=marg[:, k], minlength=len(words)) for k in range(size)], axis=1)
        grad = (true - soft) / total
        gw = np.zeros((1 << TABLE_BITS, size))
        for at, feats in blocks:
            for k in range(size):
                gw[:, k] += np.bincount(feats.ravel(), np.repeat(grad[at, k], feats.shape[1]), 1 << TABLE_BITS)
        gw[0] = 0
        gl = np.zeros_like(crf.lexicon_weights)
        gl[slot[in_lexicon]] = grad[in_lexicon]
        steps = (gw - l2 * crf.weights, gl - l2 * crf.lexicon_weights,
                 (pairs_true - pairs) / total, (start_true - marg[:offsets[1]].sum(axis=0)) / total)
        for x, g, m in zip((crf.weights, crf.lexicon_weights, crf.transitions, crf.start), steps, memory):
            g = g * 1000
            m += g * g
            x += (rate * g / np.sqrt(m)).astype(x.dtype)
    return crf


def _feature_blocks(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, feature numbers) of blocks of words of about one length, so
    that a block has few empty slots and a training round small temporaries."""
    order = np.argsort([len(w) for w in words], kind="stable")
    parts = [order[a:a + BLOCK_WORDS] for a in range(0, len(words), BLOCK_WORDS)]
    return [(at, word_features([words[i] for i in at])) for at in parts]


class Labeller:
    """Labels batches of texts; keeps the potentials of known words."""

    def __init__(self, crf: Crf, cache_words: int = CACHE_WORDS):
        self.crf, self.limit = crf, cache_words
        self._reset()

    def _reset(self) -> None:
        self.row: dict[str, int] = {}
        self.used = 1
        self.phi = np.ones((1 << 12, len(self.crf.languages)), np.float32)

    def _learn(self, words: list[str]) -> None:
        cores = [w if _INNER in w else letters_of(w) for w in words]
        fresh = sorted({c for c in cores if c})
        log = self.crf.potentials(fresh)
        need = self.used + len(fresh)
        while len(self.phi) < need:
            self.phi = np.concatenate([self.phi, np.ones_like(self.phi)])
        self.phi[self.used:need] = np.exp(log - log.max(axis=1, keepdims=True)) if len(fresh) else log
        place = {c: self.used + i for i, c in enumerate(fresh)}
        place[""] = 0  # no letter
        self.used = need
        self.row.update((w, place[c]) for w, c in zip(words, cores))

    def marginals(self, texts: list[str | None]):
        """Marginals of all texts' positions, with their time-major layout."""
        split = [positions_of(t) for t in texts]
        distinct = set().union(*split)
        new = distinct.difference(self.row)
        if len(self.row) + len(new) > self.limit:
            self._reset()
            new = distinct
        self._learn(sorted(new))
        ids = []
        for ws in split:
            x = np.fromiter(map(self.row.__getitem__, ws), np.int64, len(ws))
            ids.append(x[x > 0])
        order, rows, offsets = _ragged(ids)
        return self.crf.marginals(self.phi, rows, offsets), order, offsets

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.crf.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        marg, order, offsets = self.marginals(texts)
        mass = np.zeros((len(texts), len(self.crf.languages)))
        for a, b in zip(offsets, offsets[1:]):
            mass[order[:b - a]] += marg[a:b]
        total = mass.sum(axis=1)
        top = mass.argmax(axis=1)
        return ([self.crf.languages[k] if n > 0 else UNKNOWN for k, n in zip(top, total)],
                [float(m[k] / n) if n > 0 else 0.0 for m, k, n in zip(mass, top, total)])

    def word_languages(self, text: str | None) -> list[str]:
        """The language of each word with a letter: the largest marginal."""
        if not self.crf.languages or not text:
            return []
        marg, _, _ = self.marginals([text])
        sizes = [n for n in (len(word_pieces(letters_of(w))) for w in text.split()) if n]
        if not sizes:
            return []
        mass = np.add.reduceat(marg, np.cumsum([0, *sizes[:-1]]), axis=0)
        return [self.crf.languages[k] for k in mass.argmax(axis=1)]


def language_bounds(texts: dict[str, int], max_train_rows: int = MAX_TRAIN_ROWS) -> dict[str, int]:
    """How many of each language's texts to learn from: all, or a common number
    that makes ``max_train_rows`` together, at least ``MIN_LANGUAGE_ROWS`` (with
    many languages fewer: 20 times ``max_train_rows`` together, but one of each)."""
    left, bound = max_train_rows, 0
    for k, n in enumerate(sorted(texts.values())):
        bound = left // (len(texts) - k)
        if n > bound:
            break
        left -= n
    else:
        return dict(texts)
    least = max(1, min(MIN_LANGUAGE_ROWS, 20 * max_train_rows // len(texts)))
    return {lang: min(n, max(bound, least)) for lang, n in texts.items()}


def training_sample(docs: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, text_col: str = "text",
                    lang_col: str = "lang") -> DataFrame:
    """(text, lang) to learn from: distinct texts, about ``language_bounds`` of
    each language (their numbers are estimates)."""
    known = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull())
    counted = known.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).collect()
    texts = {r["lang"]: r["n"] for r in counted}
    bounds = language_bounds(texts, max_train_rows)
    # a text that all rows of a language share has the estimate 1: no share is below one text's
    below = [(lang, _RANGE if n >= texts[lang] else max(1, n * _RANGE // texts[lang])) for lang, n in bounds.items()]
    limits = docs.sparkSession.createDataFrame(below, "lang string, below long")
    drawn = known.join(F.broadcast(limits), "lang").where(F.pmod(F.xxhash64("text"), F.lit(_RANGE)) < F.col("below"))
    return drawn.select("text", "lang").distinct()


def training_chunks(docs: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, text_col: str = "text",
                    lang_col: str = "lang", chunk: int = CHUNK, train_chunks: int = TRAIN_CHUNKS) -> list[tuple[str, list[str]]]:
    """(language, words) chunks of the training sample: of each text at most
    ``train_chunks`` chunks of ``chunk`` words, spread evenly over it."""
    sample = training_sample(docs, max_train_rows, text_col, lang_col)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("language")
        for b in batches:
            langs, chunks = [], []
            for text, lang in zip(b["text"], b["lang"]):
                words = [p for w in text.split() for p in word_pieces(letters_of(w))]
                pieces = [words[a:a + chunk] for a in range(0, len(words), chunk)]
                step = max(1, -(-len(pieces) // train_chunks))
                langs += [lang] * len(pieces[::step])
                chunks += ["\n".join(p) for p in pieces[::step]]
            yield pd.DataFrame({"lang": langs, "words": chunks})

    # a chunk comes as one string, and equal words become one object
    rows = sample.mapInPandas(cut, "lang string, words string").toPandas()
    rows = rows.sort_values(["lang", "words"])
    known: dict[str, str] = {}
    return [(lang, [known.setdefault(w, w) for w in words.split("\n")]) for lang, words in zip(rows["lang"], rows["words"])]


def label_languages(docs: DataFrame, crf: Crf, text_col: str = "text", words: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; with ``words`` also
    ``word_langs``, the language of each word that has a letter."""
    prepare(docs.sparkSession)
    kind = "lang_pred string, score double" + (", word_langs array<string>" if words else "")

    @F.pandas_udf(kind)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker_cache("language")
        labeller = Labeller(crf)
        for texts in batches:
            group, size = [], 0
            langs: list[str] = []
            scores: list[float] = []
            for text in texts:
                group.append(text)
                size += len(text or "")
                if size >= GROUP_CHARS:
                    found = labeller.label(group)
                    langs += found[0]
                    scores += found[1]
                    group, size = [], 0
            found = labeller.label(group) if group else ([], [])
            out = {"lang_pred": langs + found[0], "score": scores + found[1]}
            if words:
                out["word_langs"] = [labeller.word_languages(t) for t in texts]
            yield pd.DataFrame(out)

    # else a filter on the labels would run the labelling again below itself
    label = label.asNondeterministic()
    outputs = ["lang_pred", "score", *(["word_langs"] if words else [])]
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (*outputs, "_found")]
    return docs.select(*keep, label(F.col(f"`{text_col}`")).alias("_found")).select(
        *keep, *[F.col(f"_found.{c}").alias(c) for c in outputs])


def fit(docs: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> Crf:
    """Learn from the labelled documents outside the held-out fold."""
    prepare(docs.sparkSession)
    learn = docs.where(crc_fold(F.col("doc_id"), HELD_OUT_FOLDS) != HELD_OUT_FOLD)
    return train_crf(training_chunks(learn, max_train_rows))


def predict(docs: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Learn, then label all of ``docs``; ``held_out`` marks the fold not learned from."""
    return label_languages(docs, fit(docs, max_train_rows)).withColumn(
        "held_out", crc_fold(F.col("doc_id"), HELD_OUT_FOLDS) == HELD_OUT_FOLD)
