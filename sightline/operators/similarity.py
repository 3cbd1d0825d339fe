"""Hamming-distance search.

One reference against many candidates needs no join: the reference signature
is one bounded row, fetched once and inlined as literals, and the threshold
becomes an integer bound on the distance (R7), so the search is a narrow
filter fused into the scan's codegen stage.

Many references against many candidates is a theta join, planned by size:

* broadcast — the reference side is counted and found small: it is broadcast
  and the candidates stream past it without a shuffle (nested loop);
* banded — two signatures within ``r`` bits differ in at most one bit of some
  of ``r // 2 + 1`` disjoint bands (pigeonhole), so they agree in one half of it:
  both sides are dealt by (half band, value), twice a band, and each task looks
  the other half's values up, equal or one bit off.  A verify step applies the
  exact distance, and a pair is kept only on the first such band (no dedup
  shuffle).  Used when the bands are wide enough to select.  Bits that lie side
  by side, which pictures set alike, go to different bands.  Hot values are dealt
  as blocks of rows on both sides.  On request also with narrow bands: an
  equi-join on (band, value), with the references' values also one bit off; hot
  values are packed into blocks, and each two blocks are compared at once;
* metric — where bands would be too narrow: signatures go to the cell of their
  nearest pivot (of a bounded sample), and a reference is copied to the cells
  that the triangle inequality allows; one equi-join on the cell, verified.
  Hot cells go in blocks alike;
* chunked — the references are cut into numbered chunks, packed into blocks, and
  each block meets each block of candidates (on request only).  No broadcast.

A size window (P3) narrows the banded and metric joins before any pair is made:
sizes fall into logarithmic buckets, the reference's bucket is part of the join
key and a candidate is copied to the buckets whose references' windows may hold
it, so range and signature are one equi-join.  Half bands take the bucket into
the key of hot values only: elsewhere it would copy more rows than it saves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.bits import (
    hamming,
    hamming_to_literal,
    let,
    max_distance,
    n_words,
    similarity_pct,
)

# Largest reference table that is broadcast although bands would select
# (rows, counted first), and although they would not.
DEFAULT_MAX_BROADCAST_REFS = 200_000
MAX_NESTED_REFS = 2_000
# Bands narrower than this select too weakly for the banded equi-join; the
# reference table is then partitioned by pivots instead.
MIN_BAND_BITS = 12
# A (band, value) join key with more rows than this on one side, or that more
# pairs share, is compared in blocks of about so many rows.
HOT_BAND_ROWS = 100_000
BLOCK_PAIRS = 20_000
MAX_BROADCAST_HOT_KEYS = 50_000  # counted first
BLOCK_ROWS = 4_096
BLOCK_PAIRS_PER_TASK = 48
# A half band's value that more rows of one side share is dealt as blocks of so
# many rows; a task is handed about so many rows, and pairs that may agree.
CELL_ROWS = 16_384
CELL_ROWS_PER_TASK = 1 << 18
CELL_PAIRS_PER_TASK = 1 << 30
TILE_PAIRS = 1 << 17  # compared at once: the temporaries stay in a core's cache
# Size buckets double about every half bucket; a window of +-50 % touches four.
SIZE_BUCKETS_PER_E = 2.0
# Pivots of the metric partitioning, and the rows that they are drawn from.
PIVOTS = 128
PIVOT_SAMPLE_ROWS = 4_096


def score_against(candidates: DataFrame, ref_words: list[int], n_bits: int,
                  threshold: float, bits: str = "bits") -> DataFrame:
    """Rows of ``candidates`` within the threshold of one signature, with
    ``distance`` and ``similarity_pct``."""
    if len(ref_words) != n_words(n_bits):
        raise ValueError("reference signature does not have n_bits bits")
    d_max = max_distance(threshold, n_bits)
    # The row number keeps the filter above the projection: pushed below it,
    # the filter would hold a copy of the whole hash for each signature word.
    # A row without bits has no distance and passes no bound.
    scored = candidates.withColumns({
        "distance": let(F.col(bits), lambda b: hamming_to_literal(b, ref_words)),
        "_row": F.monotonically_increasing_id()})
    return (scored.where((F.col("distance") <= d_max) & (F.col("_row") >= 0)).drop("_row")
            .withColumn("similarity_pct", similarity_pct(F.col("distance"), n_bits)))


def size_bounds(ref_size: int, tolerance_pct: float | None) -> tuple[int, int] | None:
    """Inclusive byte-size window around the reference (P3); ``int()``
    truncates toward zero; a negative tolerance counts as 0."""
    if tolerance_pct is None:
        return None
    tol = max(0.0, float(tolerance_pct)) / 100.0
    return int(ref_size * (1.0 - tol)), int(ref_size * (1.0 + tol))


def _size_window(size: Column, tolerance_pct: float | None) -> tuple[Column, Column] | None:
    if tolerance_pct is None:
        return None
    tol = max(0.0, float(tolerance_pct)) / 100.0
    lo = (size.cast("double") * F.lit(1.0 - tol)).cast("bigint")
    hi = (size.cast("double") * F.lit(1.0 + tol)).cast("bigint")
    return lo, hi


def _referring_sizes(size: Column, tolerance_pct: float) -> tuple[Column, Column]:
    """Bounds of the reference sizes whose window (tolerance below 100 %) may hold
    ``size``: wider by one byte and a billionth, for truncation and rounding."""
    tol = max(0.0, float(tolerance_pct)) / 100.0
    size = size.cast("double")
    return ((size - 1) / F.lit((1.0 + tol) * (1 + 1e-9)) - 1,
            F.greatest((size + 1) / F.lit((1.0 - tol) * (1 - 1e-9)) + 1, F.lit(1.0)))


def size_bucket(size: Column) -> Column:
    """The logarithmic bucket of a byte size: rises with the size, 0 up to one."""
    return F.floor(F.ln(F.greatest(size.cast("double"), F.lit(1.0))) * SIZE_BUCKETS_PER_E).cast("int")


def _in_buckets(r: DataFrame, c: DataFrame, window: tuple[Column, Column], tolerance_pct: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_bucket``: a pair within the window meets in one bucket."""
    if tolerance_pct < 100:
        # each side is copied by bands or cells, the references most: so the
        # candidates go to all buckets of references whose window may hold them
        reach = _referring_sizes(F.col("file_size"), tolerance_pct)
        return (r.withColumn("_bucket", size_bucket(F.col("_rsize"))),
                c.withColumn("_bucket", F.explode(F.sequence(*map(size_bucket, reach)))))
    # the buckets of the window, inclusive; none if no size can lie in it
    return (r.withColumn("_bucket", F.explode(F.sequence(*map(size_bucket, window)))),
            c.withColumn("_bucket", size_bucket(F.col("file_size"))))


def band_layout(n_bits: int, d_max: int) -> list[tuple[int, int]]:
    """(0-based start, length) of ``d_max // 2 + 1`` near-equal bands: with
    fewer than two differences a band on average, two signatures within
    ``d_max`` bits differ in at most one bit of some band."""
    bands = d_max // 2 + 1
    if bands > n_bits:
        raise ValueError("threshold admits pairs that differ in every bit; "
                         "banding cannot narrow them")
    base, extra = divmod(n_bits, bands)
    out, start = [], 0
    for i in range(bands):
        length = base + (1 if i < extra else 0)
        out.append((start, length))
        start += length
    return out


def _band_value(bits: Column, n_bits: int, start: int, length: int) -> Column:
    """Bits ``start .. start + length`` (at most 63) as one BIGINT, cut from
    the words by shift and mask."""
    pad = 64 * n_words(n_bits) - n_bits  # the first word carries the short rest
    low, high = start + pad, start + pad + length
    value = None
    for w in range(low // 64, (high - 1) // 64 + 1):
        lo, hi = max(low, 64 * w) - 64 * w, min(high, 64 * w + 64) - 64 * w
        part = F.shiftrightunsigned(bits.getItem(w), 64 - hi).bitwiseAND(
            F.lit((1 << (hi - lo)) - 1).cast("bigint"))
        value = part if value is None else F.shiftleft(value, hi - lo).bitwiseOR(part)
    return value


def pair_search(refs: DataFrame, candidates: DataFrame, n_bits: int, threshold: float,
                ref_key: str, cand_key: str, *, bits: str = "bits",
                size: str | None = None, size_tolerance_pct: float | None = None,
                exclude_self: bool = True,
                max_broadcast_refs: int = DEFAULT_MAX_BROADCAST_REFS,
                strategy: str | None = None, hot_band_rows: int = HOT_BAND_ROWS) -> DataFrame:
    """All (reference, candidate) pairs within the threshold.

    Returns ``reference, candidate, distance, similarity_pct`` plus
    ``file_size`` when ``size`` names the candidates' size column.
    ``strategy`` ('broadcast', 'banded', 'metric', 'chunked') overrides the choice.
    """
    d_max = max_distance(threshold, n_bits)
    windowed = size is not None and size_tolerance_pct is not None
    r_cols = [F.col(ref_key).alias("reference"), F.col(bits).alias("_rbits")]
    c_cols = [F.col(cand_key).alias("candidate"), F.col(bits).alias("_cbits")]
    if size is not None:
        r_cols.append(F.col(size).alias("_rsize"))
        c_cols.append(F.col(size).alias("file_size"))
    r = refs.where(F.col(bits).isNotNull()).select(*r_cols)
    c = candidates.where(F.col(bits).isNotNull()).select(*c_cols)
    window = _size_window(F.col("_rsize"), size_tolerance_pct) if windowed else None

    cond = F.lit(True)
    if exclude_self:
        cond = cond & (F.col("reference") != F.col("candidate"))
    if windowed:
        cond = cond & F.col("file_size").between(*window)
    dist = hamming(F.col("_rbits"), F.col("_cbits"), n_bits)
    n_refs = r.count() if d_max >= 0 else 0
    if strategy is None:
        wide = 0 <= d_max < n_bits and n_bits // (d_max // 2 + 1) >= MIN_BAND_BITS
        if n_refs <= min(MAX_NESTED_REFS, max_broadcast_refs):
            strategy = "broadcast"
        elif wide:
            strategy = "banded"
        else:  # cells separate less than bands: a window makes up for that
            strategy = "broadcast" if n_refs <= max_broadcast_refs and not windowed else "metric"
    bucketed = None
    if windowed and strategy in ("banded", "metric"):
        low, high = window
        r, c = r.where(low <= high), c.where(F.col("file_size").isNotNull())
        bucketed = lambda r, c: _in_buckets(r, c, window, size_tolerance_pct)
    if d_max < 0 or n_refs == 0:
        joined = c.join(F.broadcast(r), F.lit(False), "inner")
    elif strategy == "broadcast":
        joined = c.join(F.broadcast(r), (dist <= d_max) & cond, "inner")
    elif strategy == "banded":
        joined = _banded_join(r, c, n_bits, d_max, hot_band_rows, bucketed).where(cond)
    elif strategy == "metric":
        r, c = bucketed(r, c) if bucketed else (r, c)
        joined = _metric_join(r, c, n_bits, d_max, hot_band_rows).where(cond)
    elif strategy == "chunked":
        joined = _chunked_join(r, c, n_bits, d_max, n_refs, max(1, max_broadcast_refs)).where(cond)
    else:
        raise ValueError(f"unknown join strategy {strategy!r}")
    if "distance" not in joined.columns:
        joined = joined.withColumn("distance", dist)
    out = joined.withColumn("similarity_pct", similarity_pct(F.col("distance"), n_bits))
    cols = ["reference", "candidate", "distance", "similarity_pct"]
    if size is not None:
        cols.append("file_size")
    return out.select(*cols)


def _chunked_join(r: DataFrame, c: DataFrame, n_bits: int, d_max: int, n_refs: int, max_rows: int) -> DataFrame:
    """Block nested loop: references numbered into chunks of at most ``max_rows``,
    chunks packed into blocks, candidates into blocks by a hash; every block of
    references meets every block of candidates in a task of its own.  Exact,
    nothing passes the driver, and no task holds more than two blocks at once."""
    # numbered, not hashed: every chunk has at most ``max_rows``, also where
    # references repeat
    from sightline.operators.ranking import number_rows
    from sightline.session import fix
    chunk = min(max_rows, BLOCK_ROWS)
    per_block = BLOCK_ROWS // chunk * chunk
    numbered = number_rows(r, [F.col(x) for x in r.columns], known_rows=n_refs)
    r = numbered.withColumn("_i", F.floor((F.col("rank") - 1) / per_block).cast("int")).drop("rank")
    parts_r, parts_c = -(-n_refs // per_block), max(1, -(-c.count() // BLOCK_ROWS))
    c = c.withColumn("_j", _part("candidate", "_cbits", F.lit(parts_c)))
    left = fix(_packed(r, "_rbits", n_bits, ["_i"], "_r")).withColumn(
        "_j", F.explode(F.sequence(F.lit(0), F.lit(parts_c - 1))))
    right = fix(_packed(c, "_cbits", n_bits, ["_j"], "_c")).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.lit(parts_r - 1))))
    return _compare_blocks(left, right, [], parts_r * parts_c, n_bits, d_max)


def _band_keys(band: int, value: Column):
    return lambda mask: F.struct(F.lit(band).alias("band"), value.bitwiseXOR(mask).alias("value"))


def _banded_join(r: DataFrame, c: DataFrame, n_bits: int, d_max: int, hot_rows: int = HOT_BAND_ROWS,
                 bucketed: Callable | None = None) -> DataFrame:
    """The pairs within ``d_max`` bits; ``bucketed`` gives both sides a ``_bucket`` of
    their sizes, which pairs of interest share."""
    if n_bits // (d_max // 2 + 1) >= MIN_BAND_BITS:
        return _half_band_join(r, c, n_bits, d_max, hot_rows, bucketed)
    layout = band_layout(n_bits, d_max)
    if bucketed:
        r, c = bucketed(r, c)

    def banded(df: DataFrame, bits: str, probes: bool) -> DataFrame:
        """One row per band value; with ``probes`` also for every value one bit
        off, so that only this side grows."""
        keys = []
        for i, (start, length) in enumerate(layout):
            value = _band_value(F.col(bits), n_bits, start, length)
            flips = [0, *(1 << k for k in range(length))] if probes else [0]
            masks = F.expr("array(" + ", ".join(f"{m}L" for m in flips) + ")")
            keys.append(F.transform(masks, _band_keys(i, value)))
        return (df.withColumn("_b", F.explode(F.concat(*keys)))
                  .withColumn("_band", F.col("_b.band"))
                  .withColumn("_value", F.col("_b.value")).drop("_b"))

    bucket = ["_bucket"] if "_bucket" in c.columns else []
    return _salted_join(banded(r, "_rbits", True), banded(c, "_cbits", False), ["_band", "_value", *bucket], hot_rows,
                        n_bits, d_max, layout)


def spread_bits(n_bits: int, bands: int) -> list[int]:
    """An order of the bits that puts those of a band one after another.  Hashes are
    square and row-major: going right or down by one leads to another band."""
    side = math.isqrt(n_bits)
    return sorted(range(n_bits), key=lambda k: ((k + k // side) % bands, k))


def _reordered(df: DataFrame, bits: str, n_bits: int, order: list[int]) -> DataFrame:
    """``df`` with its signatures' bits in another order, as words ``_w0``, ``_w1``, …;
    without those that lack a word, which have no distance to any other."""
    from sightline.session import ship_package

    ship_package(df.sparkSession)
    words, own = n_words(n_bits), [x for x in df.columns if x != bits]
    pad = 64 * words - n_bits
    take = np.array([*range(pad), *(pad + k for k in order)])
    names = [f"_w{w}" for w in range(words)]

    def reorder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(own):]], axis=1)
            ones = np.unpackbits(x.astype(">i8").view(np.uint8), axis=1)
            x = np.ascontiguousarray(np.packbits(ones[:, take], axis=1)).view(">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(own)], *map(pa.array, np.ascontiguousarray(x.T))],
                                             names=[*own, *names])

    parts = [F.col(bits).getItem(w) for w in range(words)]
    whole = df.where(~F.greatest(*[w.isNull() for w in parts], F.lit(False)))
    schema = T.StructType([*(df.schema[x] for x in own), *(T.StructField(x, T.LongType()) for x in names)])
    return whole.select(*own, *[w.alias(x) for w, x in zip(parts, names)]).mapInArrow(reorder, schema)


def _half_band_join(r: DataFrame, c: DataFrame, n_bits: int, d_max: int, hot_rows: int = HOT_BAND_ROWS,
                    bucketed: Callable | None = None) -> DataFrame:
    """The pairs within ``d_max`` bits, with ``distance`` (without bits): bands in which
    they differ in at most one bit have an equal half, by which both sides are dealt.

    A half's value that more than ``CELL_ROWS`` (or ``hot_rows``) rows of either side
    share is hot: its rows are dealt by size bucket too, and as blocks by a hash, each
    two blocks to a task that need not be that of the others.  Values are counted
    map-side; the counts stay a table, and the hot ones are counted before they are
    broadcast."""
    from sightline.session import fix

    # any larger number of bands does as well: halves of 31 bits at most
    layout = band_layout(n_bits, max(d_max, 2 * (-(-n_bits // 62) - 1)))
    order, words = spread_bits(n_bits, len(layout)), [f"_w{w}" for w in range(n_words(n_bits))]
    halves = [part for start, n in layout for part in ((start, n // 2), (start + n // 2, n - n // 2))]
    r_own, c_own = ([x for x in df.columns if x not in ("_rbits", "_cbits")] for df in (r, c))

    def dealt(df: DataFrame, bits: str) -> DataFrame:
        df, signature = _reordered(df, bits, n_bits, order), F.array(*words)
        keys = [F.struct(F.lit(h).alias("_half"), _band_value(signature, n_bits, *part).cast("int").alias("_value"))
                for h, part in enumerate(halves)]
        return df.withColumn("_h", F.explode(F.array(*keys))).select(*df.columns, "_h._half", "_h._value")

    def counted(r: DataFrame, c: DataFrame, key: list[str]) -> DataFrame:
        both = r.select(*key, F.lit(1).alias("_r")).unionByName(c.select(*key, F.lit(0).alias("_r")))
        return fix(both.groupBy(*key).agg(F.sum("_r").alias("_nr"), F.sum(1 - F.col("_r")).alias("_nc")))

    limit, key = max(1, min(hot_rows, CELL_ROWS)), ["_half", "_value"]
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / F.lit(float(limit))), F.lit(1)).cast("int")
    is_hot, on_both = F.greatest("_nr", "_nc") > limit, F.least("_nr", "_nc") > 0
    copied = F.col("_nr") * blocks("_nc") + F.col("_nc") * blocks("_nr")
    work = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(copied), F.lit(0)), F.coalesce(
        F.sum(F.col("_nr").cast("double") * F.col("_nc")), F.lit(0.0))).first()
    left, right = dealt(r, "_rbits"), dealt(c, "_cbits")
    counts = counted(left, right, key)
    n_hot = counts.where(is_hot).count()
    _, rows, pairs = work(counts.where(~is_hot))
    cell = [*key, *(["_bucket"] if bucketed else []), "_i", "_j"]
    only = {"_bucket": F.lit(-1)} if bucketed else {}
    cold = lambda df: df.withColumns({**only, "_i": F.lit(0), "_j": F.lit(0)})
    if not n_hot:
        sides = cold(left), cold(right)
    else:
        by = lambda n: F.broadcast if n <= MAX_BROADCAST_HOT_KEYS else lambda df: df.hint("merge")
        hot = by(n_hot)(counts.where(is_hot).select(*key))
        rest = [cold(df.join(hot, key, "left_anti")) for df in (left, right)]
        left, right, cells = left.join(hot, key), right.join(hot, key), counts.where(is_hot & on_both)
        if bucketed:
            left, right = bucketed(left, right)
            cells = counted(left, right, cell[:-2]).where(on_both)
        n_cells, more_rows, more_pairs = work(cells)
        rows, pairs = rows + more_rows, pairs + more_pairs
        cells = by(n_cells)(cells.select(*cell[:-2], blocks("_nr").alias("_ni"), blocks("_nc").alias("_nj")))
        copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        block = lambda row, n: _part(row, F.array(*words), F.col(n))
        left = left.join(cells, cell[:-2]).withColumn("_i", block("reference", "_ni")).withColumn("_j", copies("_nj"))
        right = right.join(cells, cell[:-2]).withColumn("_j", block("candidate", "_nj")).withColumn("_i", copies("_ni"))
        sides = [a.unionByName(b.drop("_ni", "_nj")) for a, b in zip(rest, (left, right))]
    left, right = (df.select(F.lit(is_r).alias("_r"), *own, *words, *cell)
                   for df, own, is_r in zip(sides, (r_own, c_own), (True, False)))
    partitions = max(int(r.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // CELL_ROWS_PER_TASK),
                     math.ceil(pairs / CELL_PAIRS_PER_TASK))
    together = left.unionByName(right, allowMissingColumns=True).repartition(partitions, *cell)
    schema = T.StructType([*(r.schema[x] for x in r_own), *(c.schema[x] for x in c_own), T.StructField("distance", T.IntegerType())])
    names, n_own = schema.names, len(r_own)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        del held
        column = lambda name: rows.column(name).to_numpy()
        signatures = np.stack([column(x) for x in words]).view(np.uint64)
        cells = _ranks([column(x) for x in cell])
        found = _half_band_pairs(signatures, column("_r"), column("_half"), cells, n_bits, d_max, layout, halves)
        for i, j, distance in _together(found):
            at = [pa.array(i)] * n_own + [pa.array(j)] * (len(names) - 1 - n_own)
            yield from pa.table([*(rows.column(x).take(k) for x, k in zip(names, at)), pa.array(distance.astype(np.int32))],
                                names=names).to_batches()

    return together.mapInArrow(compare, schema)


def _ranks(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each row, the same where all columns are equal."""
    out = np.zeros(len(columns[0]), np.int64)
    for x in columns:
        values, at = np.unique(x, return_inverse=True)
        if len(values) > 1:
            out = np.unique(out * len(values) + at, return_inverse=True)[1]
    return out


def _bits_at(signatures: np.ndarray, n_bits: int, start: int, length: int) -> np.ndarray:
    """``_band_value`` of signatures (words x rows)."""
    pad = 64 * n_words(n_bits) - n_bits
    low, high = start + pad, start + pad + length
    value = np.zeros(signatures.shape[1], np.int64)
    for w in range(low // 64, (high - 1) // 64 + 1):
        lo, hi = max(low, 64 * w) - 64 * w, min(high, 64 * w + 64) - 64 * w
        part = (signatures[w] >> np.uint64(64 - hi)) & np.uint64((1 << (hi - lo)) - 1)
        value = value << (hi - lo) | part.astype(np.int64)
    return value


def _half_band_pairs(signatures: np.ndarray, is_ref: np.ndarray, half: np.ndarray, cell: np.ndarray, n_bits: int, d_max: int,
                     layout: list[tuple[int, int]], halves: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(reference's row, candidate's row, distance) of the rows of one cell within
    ``d_max`` bits, on their first band.  The rows of a cell agree in one half; of the
    other half each value is looked up as it is and one bit off: the second halves'
    cells only one bit off, as equal halves meet in the cells of the first."""
    for h in np.unique(half):
        start, length = halves[h ^ 1]
        ref, cand = np.flatnonzero((half == h) & is_ref), np.flatnonzero((half == h) & ~is_ref)
        place = lambda rows: cell[rows] << 32 | _bits_at(signatures[:, rows], n_bits, start, length)
        at_ref, at_cand = place(ref), place(cand)
        by_ref, by_cand = np.argsort(at_ref, kind="stable"), np.argsort(at_cand, kind="stable")
        ref, at_ref, cand = ref[by_ref], at_ref[by_ref], cand[by_cand]
        values, first, number = np.unique(at_cand[by_cand], return_index=True, return_counts=True)
        if not len(values):
            continue
        hits = []
        for flip in [*([] if h % 2 else [0]), *(1 << k for k in range(length))]:
            wanted = at_ref ^ flip
            at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
            equal = np.flatnonzero(values[at] == wanted)
            hits.append((equal, at[equal]))
        row, at = (np.concatenate(x) for x in zip(*hits))
        many, row, at = number[at], ref[row], first[at]
        ends = np.cumsum(many)
        s = 0
        while s < len(row):  # rows of the references that share about a tile's pairs
            done = int(ends[s - 1]) if s else 0
            e = max(s + 1, int(np.searchsorted(ends, done + TILE_PAIRS, side="right")))
            n = many[s:e]
            i = np.repeat(row[s:e], n)
            j = cand[np.arange(int(ends[e - 1]) - done) + np.repeat(at[s:e] - (ends[s:e] - n - done), n)]
            s = e
            distance = np.zeros(len(i), np.uint16)
            for x in signatures:  # most pairs are too far by the first words
                distance = distance + np.bitwise_count(x[i] ^ x[j])
                near = np.flatnonzero(distance <= d_max)
                i, j, distance = i[near], j[near], distance[near]
            mine = _first_bands(signatures[:, i] ^ signatures[:, j], n_bits, layout) == h // 2
            if mine.any():
                yield i[mine], j[mine], distance[mine]


def _salted_join(r: DataFrame, c: DataFrame, key: list[str], hot_rows: int, n_bits: int, d_max: int,
                 layout: list[tuple[int, int]] | None = None) -> DataFrame:
    """The pairs of ``r`` and ``c`` that agree in ``key`` and lie within ``d_max``
    bits, with ``distance`` (without key and bits); with a ``layout`` of bands, each
    pair on its first band only.

    A key that more than ``hot_rows`` rows of either side or more than
    ``BLOCK_PAIRS`` pairs share is hot: its rows are packed into blocks by a hash,
    on both sides, and each two blocks are compared by a task that need not be
    that of the key's other blocks.  All other keys go through an equi-join.
    Counting aggregates map-side; the hot keys stay a table, and are counted
    before they are broadcast."""
    from sightline.session import fix

    count = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    blocks = lambda n: F.ceil(F.col(n) / F.lit(float(BLOCK_ROWS))).cast("int")
    # Spark judges the bands' rows by the table that they were exploded from and
    # would broadcast them by way of the driver: these joins are named
    hot = fix(count(c, "_nc").hint("merge").join(count(r, "_nr"), key)
              .where((F.greatest("_nc", "_nr") > hot_rows)
                     | (F.col("_nc").cast("double") * F.col("_nr") > F.lit(float(BLOCK_PAIRS))))
              .select(*key, blocks("_nr").alias("_ni"), blocks("_nc").alias("_nj")))
    n_hot, n_pairs = hot.agg(F.count(F.lit(1)), F.sum(F.col("_ni").cast("bigint") * F.col("_nj"))).first()
    by_hot = lambda columns: (F.broadcast if n_hot <= MAX_BROADCAST_HOT_KEYS else lambda df: df.hint("merge"))(hot.select(*columns))
    rest = c.join(by_hot(key), key, "left_anti") if n_hot else c
    rest = rest.hint("merge").join(r, key)
    rest = rest.where(hamming(F.col("_rbits"), F.col("_cbits"), n_bits) <= d_max)
    if layout:  # the first band where both differ in at most one bit
        first = F.coalesce(*[
            F.when(F.bit_count(_band_value(F.col("_rbits"), n_bits, st, ln).bitwiseXOR(
                _band_value(F.col("_cbits"), n_bits, st, ln))) <= 1, F.lit(i))
            for i, (st, ln) in enumerate(layout)])
        rest = rest.where(first == F.col("_band"))
    rest = rest.withColumn("distance", hamming(F.col("_rbits"), F.col("_cbits"), n_bits)).drop(
        *key, "_rbits", "_cbits")
    if not n_hot:
        return rest
    left = _packed(r.join(by_hot(hot.columns), key).withColumn("_i", _part("reference", "_rbits", F.col("_ni"))).drop("_ni"),
                   "_rbits", n_bits, [*key, "_nj", "_i"], "_r")
    right = _packed(c.join(by_hot(hot.columns), key).withColumn("_j", _part("candidate", "_cbits", F.col("_nj"))).drop("_nj"),
                    "_cbits", n_bits, [*key, "_ni", "_j"], "_c")
    left = left.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nj") - 1))).drop("_nj")
    right = right.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_ni") - 1))).drop("_ni")
    found = _compare_blocks(left, right, key, n_pairs, n_bits, d_max, layout)
    return found.unionByName(rest.select(*found.columns))


def _part(row_key: str, bits: str | Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(row_key, bits), parts).cast("int")


def _packed(df: DataFrame, bits: str, n_bits: int, by: list[str], name: str) -> DataFrame:
    """One row for each block: its rows as an array of structs, signatures by word."""
    words = [F.col(bits).getItem(i).alias(f"_w{i}") for i in range(n_words(n_bits))]
    rows = df.where(~F.greatest(*[w.isNull() for w in words], F.lit(False)))
    return rows.groupBy(*by).agg(F.collect_list(F.struct(
        *[F.col(x) for x in df.columns if x not in (*by, bits)], *words)).alias(name))


def _near_pairs(a: np.ndarray, b: np.ndarray, d_max: int, away: np.ndarray | None = None,
                radius: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of ``a``, row of ``b``, distance) of the signatures (words x rows) within
    ``d_max`` bits, a few rows of ``a`` at a time.  With ``away`` and ``radius``, their
    distances to one pivot, rows that these rule out are not compared."""
    order_a, order_b = np.arange(a.shape[1]), np.arange(b.shape[1])
    if away is not None:
        order_a, order_b = np.argsort(away, kind="stable"), np.argsort(radius, kind="stable")
        away, radius = away[order_a], radius[order_b]
        a, b = np.ascontiguousarray(a[:, order_a]), np.ascontiguousarray(b[:, order_b])
    step = max(1, TILE_PAIRS // max(1, b.shape[1]))
    for s in range(0, a.shape[1], step):
        lo, hi = 0, b.shape[1]
        if away is not None:
            lo = int(np.searchsorted(radius, away[s] - d_max))
            hi = int(np.searchsorted(radius, away[min(s + step, len(away)) - 1] + d_max, side="right"))
        distance = np.zeros((min(step, a.shape[1] - s), max(0, hi - lo)), np.uint16)
        for x, y in zip(a, b):
            distance += np.bitwise_count(x[s:s + step, None] ^ y[None, lo:hi])
        i, j = np.nonzero(distance <= d_max)
        if len(i):
            yield order_a[i + s], order_b[j + lo], distance[i, j]


def _first_bands(x: np.ndarray, n_bits: int, layout: list[tuple[int, int]]) -> np.ndarray:
    """For differing bits (words x pairs): the first band with at most one."""
    pad = 64 * n_words(n_bits) - n_bits
    first = np.full(x.shape[1], -1)
    for i, (start, length) in reversed(list(enumerate(layout))):
        low, high = start + pad, start + pad + length
        ones = np.zeros(x.shape[1], np.uint8)
        for w in range(low // 64, (high - 1) // 64 + 1):
            lo, hi = max(low, 64 * w) - 64 * w, min(high, 64 * w + 64) - 64 * w
            mask = ((1 << (hi - lo)) - 1) << (64 - hi)
            ones += np.bitwise_count(x[w] & np.uint64(mask))
        first[ones <= 1] = i
    return first


def _compare_blocks(left: DataFrame, right: DataFrame, key: list[str], n_pairs: int, n_bits: int, d_max: int,
                    layout: list[tuple[int, int]] | None = None) -> DataFrame:
    """``_salted_join`` of the blocks ``left`` (key, _i, _j, _r) and ``right`` (key, _i,
    _j, _c): all rows of the two blocks of one key, _i and _j are compared.  The
    partitions are as many as hold a few block pairs each, which bounds what a
    Python worker is handed at once."""
    from sightline.session import ship_package

    ship_package(left.sparkSession)
    words = n_words(n_bits)
    names = {side: [f for f in df.schema[side].dataType.elementType if not f.name.startswith("_w")]
             for side, df in (("_r", left), ("_c", right))}
    kept = [(side, f) for side in ("_r", "_c") for f in names[side] if f.name not in ("_away", "_radius")]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for _, f in kept), T.StructField("distance", T.IntegerType())])
    by_pivot = any(f.name == "_away" for f in names["_r"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = lambda rows: np.stack([rows.field(f"_w{w}").to_numpy(zero_copy_only=False) for w in range(words)]).view(np.uint64)
        numbers = lambda rows, name: rows.field(name).to_numpy(zero_copy_only=False) if by_pivot else None
        for batch in batches:
            for at in range(batch.num_rows):
                rows = {side: batch.column(side)[at].values for side in ("_r", "_c")}
                a, b = signatures(rows["_r"]), signatures(rows["_c"])
                for i, j, distance in _together(_near_pairs(a, b, d_max, numbers(rows["_r"], "_away"), numbers(rows["_c"], "_radius"))):
                    if layout:
                        mine = _first_bands(a[:, i] ^ b[:, j], n_bits, layout) == batch.column("_band")[at].as_py()
                        i, j, distance = i[mine], j[mine], distance[mine]
                    if len(i):
                        take = {"_r": pa.array(i), "_c": pa.array(j)}
                        yield pa.RecordBatch.from_arrays(
                            [*(rows[side].field(f.name).take(take[side]) for side, f in kept), pa.array(distance.astype(np.int32))],
                            names=schema.names)

    # at least as many as the session's shuffles have: a pair of blocks is much work
    partitions = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_pairs // BLOCK_PAIRS_PER_TASK))
    on = [*key, "_i", "_j"]
    pairs = left.repartition(partitions, *on).hint("shuffle_hash").join(right.repartition(partitions, *on), on)
    return pairs.select(*(["_band"] if layout else []), "_r", "_c").mapInArrow(compare, schema)


def _together(parts: Iterator[tuple], rows: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """Tuples of arrays joined up to about ``rows`` rows."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= rows:
            yield [np.concatenate(x) for x in zip(*held)]
            held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def choose_pivots(signatures: DataFrame, n_bits: int, pivots: int = PIVOTS,
                  sample_rows: int = PIVOT_SAMPLE_ROWS) -> list[list[int]]:
    """At most ``pivots`` signatures far from one another, out of about
    ``sample_rows`` distinct ones drawn by a hash (a bounded sample: the driver
    sees no other row).  Any choice is exact; a spread one separates better."""
    distinct = signatures.select("_bits").distinct()
    n = distinct.count()
    below = (1 << 62) if n <= sample_rows else max(1, sample_rows * (1 << 62) // n)
    drawn = distinct.where(F.pmod(F.xxhash64("_bits"), F.lit(1 << 62)) < below).collect()
    rows = sorted(list(r["_bits"]) for r in drawn)
    if not rows:
        return []
    words = np.array(rows, np.int64).view(np.uint64)
    chosen, nearest = [0], np.full(len(rows), n_bits + 1)
    while len(chosen) < min(pivots, len(rows)):  # the row farthest from those chosen
        away = np.bitwise_count(words ^ words[chosen[-1]]).sum(axis=1, dtype=np.int64)
        nearest = np.minimum(nearest, away)
        if not nearest.max():
            break
        chosen.append(int(nearest.argmax()))
    return [rows[i] for i in chosen]


def _metric_join(r: DataFrame, c: DataFrame, n_bits: int, d_max: int, hot_rows: int = HOT_BAND_ROWS,
                 pivots: int = PIVOTS) -> DataFrame:
    """Every candidate lies in the cell of its nearest pivot.  A pair within
    ``d_max`` has, with the candidate's pivot p and the reference's own nearest q,
    d(r, p) <= d(c, p) + d_max and d(c, p) <= d(c, q) <= d(r, q) + d_max, and d(r, p) is
    within ``d_max`` of the cell's smallest and largest radius: so r goes to the
    cells with d(r, p) <= d(r, q) + 2 d_max whose radii allow it, each pair meets in one cell, and
    the join's rows are verified."""
    from sightline.session import fix

    # a signature that lacks a word has no distance to any other
    whole = lambda bits: ~F.greatest(*[F.col(bits).getItem(w).isNull() for w in range(n_words(n_bits))], F.lit(False))
    r, c = r.where(whole("_rbits")), c.where(whole("_cbits"))
    points = choose_pivots(r.select(F.col("_rbits").alias("_bits")).unionByName(
        c.select(F.col("_cbits").alias("_bits"))), n_bits, pivots)
    if not points:
        return c.join(F.broadcast(r.drop("_bucket")), F.lit(False)).withColumn("distance", F.lit(0))
    cells = fix(_to_cells(c, "_cbits", points, n_bits, "_radius"))
    radii = {x["_cell"]: (x["low"], x["high"]) for x in  # one row for each pivot
             cells.groupBy("_cell").agg(F.min("_radius").alias("low"), F.max("_radius").alias("high")).collect()}
    copied = _to_cells(r, "_rbits", points, n_bits, "_away", d_max, radii)
    bucket = ["_bucket"] if "_bucket" in c.columns else []
    # the radii rule most pairs of a block out before any bits are compared
    return _salted_join(copied, cells, ["_cell", *bucket], hot_rows, n_bits, d_max).drop("_away", "_radius")


def _to_cells(df: DataFrame, bits: str, points: list[list[int]], n_bits: int, name: str, d_max: int = 0,
              radii: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """``df`` with ``_cell``, the number of the nearest pivot (the first of equals),
    and in ``name`` the distance to it; given the cells' ``radii``, a copy of each row
    for every cell that may hold a signature within ``d_max``."""
    from sightline.session import ship_package

    ship_package(df.sparkSession)
    words, own = n_words(n_bits), list(df.columns)
    pivots = np.array(points, np.int64).view(np.uint64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 4096):
                batch = whole.slice(s, 4096)
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(own):]]).view(np.uint64)
                away = np.zeros((len(pivots), batch.num_rows), np.int32)
                for w in range(words):
                    away += np.bitwise_count(x[w][None, :] ^ pivots[:, w, None])
                near = away.min(axis=0)
                if radii is None:
                    placed = [(None, pa.array(away.argmin(axis=0).astype(np.int32)), pa.array(near))]
                else:
                    placed = []
                    for p, (low, high) in sorted(radii.items()):
                        d = away[p]
                        at = np.flatnonzero((d <= near + 2 * d_max) & (d <= high + d_max) & (d >= low - d_max))
                        if len(at):
                            placed.append((pa.array(at), pa.array(np.full(len(at), p, np.int32)), pa.array(d[at])))
                for at, cell, distance in placed:
                    rows = [c if at is None else c.take(at) for c in batch.columns[:len(own)]]
                    yield pa.RecordBatch.from_arrays([*rows, cell, distance], names=[*own, "_cell", name])

    schema = T.StructType([*df.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField(name, T.IntegerType())])
    return df.select(*own, *[F.col(bits).getItem(w).alias(f"_w{w}") for w in range(words)]).mapInArrow(place, schema)
