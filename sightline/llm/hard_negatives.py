"""Hard-negative mining with rotated one-bit codes.

Vectors are scaled to integers.  Each is rotated (random signs and Hadamard
steps, from a fixed rule) and coded by the signs of its components; stored with
the code is its alignment, the inner product with the unit vector of its signs.
What the code leaves over is rotated and coded again, ``LEVELS`` times, each level
with its own alignment, and the length of the last residual is stored.

An anchor is rotated alike and quantised to eight bit planes, so that its inner
product with a code is a sum of popcounts.  Alignment times that product, summed
over the levels, estimates the score, and Cauchy-Schwarz bounds what is missing
by the residual's and the anchor's lengths (plus the quantisation's).  The
interval is certain: candidates whose interval misses the wanted scores or the
best ones found so far go after any level, and the survivors are scored as
integers.

Rows are coded once and written.  Anchors go through in blocks of at most
``BLOCK_BYTES``, broadcast one after another: one pass gives every anchor's
positives, one its negatives.  Each task keeps only the best of each anchor, and
equal anchors' bests meet in one small group.

Defined results: rows with a null label, a null vector or a null or non-finite
component take no part; shorter vectors count as filled with zeros; components
whose square summed over the dimensions would leave a long are cut to where it
doesn't; rows equal in id, label and vector count once; a null id is after all
others among equal scores and never an anchor's; anchors without positives, and
positives without negatives in range, give no row; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import discard, prepare, worker_cache, written

LEVELS = 6
PLANES = 8
BLOCK_BYTES = 8 << 20
TASK_ROWS = 100_000
POSITIVES, NEGATIVES = 5, 10
LOW_PCT, HIGH_PCT = 30, 90
SCALE = 256
NO_ID = (1 << 63) - 1  # stands for null: after all ids
_CODED = "vec_id long, label long, row long, vector binary, codes binary, aligned binary, left double"


def _signs(width: int, seed: int) -> np.ndarray:
    """A fixed row of random signs."""
    return np.random.default_rng(seed).integers(0, 2, width) * 2.0 - 1


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows of ``x`` (a power of two wide) under an orthogonal map: three rounds
    of signs and a Hadamard transform."""
    width = x.shape[1]
    y = x.astype(np.float64)
    for r in range(3):
        y = y * _signs(width, 3 * seed + r)
        h = 1
        while h < width:
            pairs = y.reshape(len(y), -1, 2, h)
            y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(y), width)
            h *= 2
        y /= math.sqrt(width)
    return y


def code_width(dimensions: int) -> int:
    """The bits of a code: a power of two, at least a word of 64."""
    return max(64, 1 << max(0, (dimensions - 1).bit_length()))


def _widened(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, code_width(x.shape[1]) - x.shape[1])))


def _words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(np.uint64)


def encode(x: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of integer rows: codes (rows x levels x words), alignments (rows x levels)
    and the length of what the last level leaves over (rounded up)."""
    rest = _widened(x).astype(np.float64)
    width = rest.shape[1]
    codes, aligned = [], []
    for level in range(levels):
        turned = rotate(rest, level)
        positive = turned >= 0
        signs = np.where(positive, 1.0, -1.0) / math.sqrt(width)
        a = (turned * signs).sum(axis=1)
        codes.append(_words(positive))
        aligned.append(a)
        rest = turned - a[:, None] * signs
    left = np.sqrt((rest ** 2).sum(axis=1)) * (1 + 1e-9)
    return np.stack(codes, axis=1), np.stack(aligned, axis=1), left


class Queries:
    """The anchors' side of the estimates: their rotations as bit planes.

    Level by level a row is ``sum of aligned * signs + residual`` in turning
    frames, so the anchors turn through the same frames."""

    def __init__(self, x: np.ndarray, levels: int = LEVELS):
        turned = _widened(x).astype(np.float64)
        n, self.width = turned.shape
        self.length = np.sqrt((turned ** 2).sum(axis=1)) * (1 + 1e-9)
        self.step, self.low, self.wrong, self.whole = (np.zeros((levels, n)) for _ in range(4))
        self.planes = np.zeros((levels, n, PLANES, self.width // 64), np.uint64)
        for level in range(levels):
            turned = rotate(turned, level)
            low = turned.min(axis=1)
            step = np.maximum((turned.max(axis=1) - low) / (2 ** PLANES - 1), 1e-12)
            units = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
            # what quantising moved: its part in a product with a unit vector is at most its length
            moved = turned - low[:, None] - step[:, None] * units
            self.step[level], self.low[level], self.wrong[level] = step, low, np.sqrt((moved ** 2).sum(axis=1))
            self.whole[level] = units.sum(axis=1)
            for j in range(PLANES):
                self.planes[level, :, j] = _words((units >> j & 1).astype(bool))

    def with_signs(self, n: int, codes: np.ndarray, level: int) -> np.ndarray:
        """The quantised anchor ``n`` times the unit vectors of the rows' signs."""
        ones = on = 0
        for word in range(codes.shape[1]):
            part = codes[:, word]
            ones = ones + np.bitwise_count(part).astype(np.int64)
            for j, plane in enumerate(self.planes[level, n, :, word]):
                on = on + (np.bitwise_count(part & plane).astype(np.int64) << j)
        # sum over set bits minus sum over the others
        value = self.step[level, n] * (2 * on - self.whole[level, n]) + self.low[level, n] * (2 * ones - self.width)
        return value / math.sqrt(self.width)


class Rows:
    """Coded rows of a task, in arrays."""

    def __init__(self, b: pd.DataFrame, dimensions: int, levels: int = LEVELS):
        n = len(b)
        self.ids = b["vec_id"].to_numpy(np.int64)
        self.labels = b["label"].to_numpy(np.int64)
        self.row = b["row"].to_numpy(np.int64)
        self.x = np.frombuffer(b"".join(b["vector"]), np.int64).reshape(n, dimensions)
        self.codes = np.frombuffer(b"".join(b["codes"]), np.uint64).reshape(n, levels, -1)
        self.aligned = np.frombuffer(b"".join(b["aligned"]), np.float64).reshape(n, levels)
        self.left = b["left"].to_numpy(np.float64)
        # the residual's length after each level, back from the last
        rest = [self.left ** 2]
        for level in range(levels - 1, 0, -1):
            rest.append(rest[-1] + self.aligned[:, level] ** 2)
        self.rest = np.sqrt(np.stack(rest[::-1], axis=1)) * (1 + 1e-9)
        self.length = np.sqrt(rest[-1] + self.aligned[:, 0] ** 2)


def intervals(rows: Rows, at: np.ndarray, queries: Queries, n: int, level: int, so_far: np.ndarray, wrong: np.ndarray):
    """Adds ``level`` to the estimates of anchor ``n`` and the rows ``at``: (estimate,
    quantising's bound, lower, upper); the score is certainly between the last two."""
    a = rows.aligned[at, level]
    estimate = so_far + a * queries.with_signs(n, rows.codes[at, level], level)
    wrong = wrong + np.abs(a) * queries.wrong[level, n]
    # and float rounding, bounded far above what can occur
    reach = (rows.rest[at, level] + 1e-9 * rows.length[at]) * queries.length[n] + wrong + 1e-3
    return estimate, wrong, estimate - reach, estimate + reach


def best(rows: Rows, at: np.ndarray, anchor: np.ndarray, queries: Queries, n: int, windows: np.ndarray, k: int,
         floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (lowest, highest score) the first ``k`` of the rows ``at`` whose
    score lies in it, by score and id, not below the window's floor:
    (positions, scores).  Intervals filter, survivors are scored as integers."""
    estimate, wrong = np.zeros(len(at)), np.zeros(len(at))
    low, high = windows[:, 0].astype(np.float64), windows[:, 1].astype(np.float64)
    floors = np.maximum(floors.astype(np.float64), low)
    for level in range(rows.codes.shape[1]):
        if len(at) <= k:
            break
        estimate, wrong, lower, upper = intervals(rows, at, queries, n, level, estimate, wrong)
        keep = np.zeros(len(at), bool)
        for w in range(len(windows)):
            sure = lower[(lower >= low[w]) & (upper <= high[w])]
            if len(sure) >= k:  # so many are surely in: none below their k-th bound is needed
                floors[w] = max(floors[w], np.partition(sure, len(sure) - k)[len(sure) - k])
            keep |= (upper >= floors[w]) & (lower <= high[w])
        at, estimate, wrong = at[keep], estimate[keep], wrong[keep]
    scores = rows.x[at] @ anchor
    out = []
    for lo, hi in windows:
        inside = np.flatnonzero((scores >= lo) & (scores <= hi))
        inside = inside[np.lexsort((rows.row[at[inside]], rows.ids[at[inside]], -scores[inside]))[:k]]
        out.append((at[inside], scores[inside]))
    return out


def code_vectors(vectors: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, int]:
    """``vectors`` (vec_id, label, embedding) as coded rows, written, and their
    dimensions.  The embedding's components are scaled and floored here."""
    spark = vectors.sparkSession
    prepare(spark)
    x = F.col("embedding")
    real = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    usable = vectors.where(F.col("label").isNotNull() & x.isNotNull()).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform(x, lambda c: c.cast("double")).alias("embedding")).where(F.forall("embedding", real)).distinct()
    rows = written(usable.withColumn("row", F.xxhash64("vec_id", "label", "embedding")), "negatives-rows")
    size = rows.agg(F.max(F.size("embedding")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    dimensions = max(1, size["width"] or 0)
    tasks = max(spark.sparkContext.defaultParallelism, size["n"] // TASK_ROWS)
    limit = float(math.isqrt((1 << 62) // dimensions))

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.zeros((len(b), dimensions))
            for i, v in enumerate(b["embedding"]):
                x[i, :len(v)] = v
            with np.errstate(over="ignore"):  # beyond the largest float: cut like all beyond the limit
                x = np.clip(np.floor(SCALE * x), -limit, limit).astype(np.int64)
            codes, aligned, left = encode(x, levels)
            out = pd.DataFrame({
                "vec_id": b["vec_id"], "label": b["label"], "row": b["row"],
                "vector": [r.tobytes() for r in x], "codes": [r.tobytes() for r in codes],
                "aligned": [r.tobytes() for r in aligned], "left": left})
            yield out

    coded = written(rows.repartition(tasks, "row").mapInPandas(encoded, _CODED), "negatives-coded")
    discard(rows)
    return coded, dimensions


def _first(found: DataFrame, keys: list[str], k: int, columns: list[str]) -> DataFrame:
    """The first ``k`` rows of each key by score and id, from the tasks' bests."""
    order = F.struct((-F.col("score")).alias("o"), "vec_id", "row", *columns)
    return (found.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(order)), 1, k).alias("top"))
            .select(*keys, F.posexplode("top").alias("at", "r"))
            .select(*keys, (F.col("at") + 1).cast("int").alias("rank"), (-F.col("r.o")).alias("score"), "r.vec_id", "r.row",
                    *[f"r.{c}" for c in columns]))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low_pct: int = LOW_PCT, high_pct: int = HIGH_PCT, levels: int = LEVELS,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each anchor (``is_anchor`` of vec_id) and each of its first ``positives``
    rows of the same label, the first ``negatives`` rows of another label whose
    score is from ``low_pct`` to ``high_pct`` hundredths of the positive's.

    Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score."""
    spark = vectors.sparkSession
    coded, dimensions = code_vectors(vectors, levels)
    anchors = coded.where(is_anchor & (F.col("vec_id") != NO_ID)).select("vec_id", "label", "row", "vector")
    # an anchor's planes and bests take about as much again as its vector
    at_once = max(1, block_bytes // (4 * 8 * code_width(dimensions)))
    blocks = max(1, -(-anchors.count() // at_once))
    done = []
    for block in range(blocks):
        chosen = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).collect()
        if chosen:
            chosen.sort(key=lambda r: (r["vec_id"], r["row"]))
            done.append(_mine_block(coded, chosen, dimensions, positives, negatives, low_pct, high_pct, levels))
    if not done:
        empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], empty)
    out = spark.read.schema(done[0].schema).parquet(*[d._written_path for d in done])
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select("anchor_id", real("positive_id"), "rank", real("negative_id"), "positive_score", "negative_score")


def _mine_block(coded: DataFrame, chosen: list, dimensions: int, positives: int, negatives: int, low_pct: int,
                high_pct: int, levels: int) -> DataFrame:
    sc = coded.sparkSession.sparkContext
    shared = sc.broadcast([(r["vec_id"], r["label"], r["row"], bytes(r["vector"])) for r in chosen])
    top, bottom = (1 << 63) - 1, -(1 << 63)

    def scan(batches: Iterator[pd.DataFrame], wanted, k: int) -> Iterator[pd.DataFrame]:
        """``wanted`` gives of an anchor's number (same label?, windows, names of them)."""
        worker_cache("negatives")
        anchors = shared.value
        vectors = np.frombuffer(b"".join(r[3] for r in anchors), np.int64).reshape(-1, dimensions)
        queries = Queries(vectors, levels)
        kept: dict[tuple, list] = {}
        for b in batches:
            rows = Rows(b, dimensions, levels)
            for n, (vec_id, label, row, _) in enumerate(anchors):
                same, windows, names = wanted(n)
                if not len(windows):
                    continue
                at = np.flatnonzero((rows.labels == label) == same)
                at = at[(rows.row[at] != row) | (rows.ids[at] != vec_id)]
                floors = np.array([kept[n, w][-1][0] if len(kept.get((n, w), ())) >= k else bottom for w in names], np.float64)
                for w, (places, scores) in zip(names, best(rows, at, vectors[n], queries, n, windows, k, floors)):
                    if len(places):
                        more = zip(scores.tolist(), rows.ids[places].tolist(), rows.row[places].tolist())
                        kept[n, w] = sorted([*kept.get((n, w), ()), *more], key=lambda r: (-r[0], *r[1:]))[:k]
        out = [(n, w, *r) for (n, w), found in kept.items() for r in found]
        yield pd.DataFrame(out, columns=["anchor", "window", "score", "vec_id", "row"])

    schema = "anchor int, window int, score long, vec_id long, row long"
    everything = np.array([[bottom, top]])

    def near(batches):
        yield from scan(batches, lambda n: (True, everything, [0]), positives)

    found = _first(coded.mapInPandas(near, schema), ["anchor"], positives, [])
    held = sorted((r["anchor"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())  # a few for each anchor
    windows: dict[int, list] = {}
    for anchor, rank, vec_id, score in held:
        lowest, highest = -(-low_pct * score // 100), high_pct * score // 100
        if lowest <= highest:
            windows.setdefault(anchor, []).append((rank, lowest, highest))
    ranges = sc.broadcast({a: ([r for r, _, _ in w], np.array([x[1:] for x in w])) for a, w in windows.items()})

    def hard(batches):
        def wanted(n):
            names, bounds = ranges.value.get(n, ([], np.zeros((0, 2), np.int64)))
            return False, bounds, names

        yield from scan(batches, wanted, negatives)

    against = _first(coded.mapInPandas(hard, schema), ["anchor", "window"], negatives, [])
    anchor_names = coded.sparkSession.createDataFrame(
        [(a, r, chosen[a]["vec_id"], i, s) for a, r, i, s in held],
        "anchor int, window int, anchor_id long, positive_id long, positive_score long")
    return written(against.join(F.broadcast(anchor_names), ["anchor", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score")), "negatives")


def oracle_sql() -> str:
    """The query's result in DuckDB: all scores."""
    return """
    WITH vectors AS (
      SELECT row_number() OVER () AS n, vec_id::BIGINT AS vec_id,
             (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
      FROM (SELECT DISTINCT vec_id, label, embedding FROM embeddings)
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
      FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.n <> b.n),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, p.positive_id,
           (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
           s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
      AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
    QUALIFY rank <= 10
    """
