"""Pairs compared in blocks, and bounded stacks of pictures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import similarity
from sightline.operators.similarity import _referring_sizes, pair_search, size_bounds, size_bucket
from sightline.plans import catalog, oracle
from sightline.sources import images


def _plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def _copies(spark, n=300):
    """Signatures with many copies, ids that repeat, a null word and sizes."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, (6, 256))
    rows = []
    for i in range(n):
        b = base[i % 6 if i % 2 else 0].copy()
        b[rng.choice(256, int(rng.integers(0, 3)) * 20, replace=False)] ^= 1
        words = np.packbits(b).view(">i8").astype(np.int64).tolist()
        rows.append((i - i % 40 // 39, None if i % 70 == 9 else [None, *words[1:]] if i % 70 == 11 else words, i * i % 977))
    return spark.createDataFrame(rows, "id long, bits array<bigint>, size long").repartition(3).cache()


@pytest.mark.parametrize("strategy,threshold", [("banded", 65.0), ("metric", 65.0), ("chunked", 65.0), ("banded", 90.0)])
def test_blocks_equal_nested_loop(spark, monkeypatch, strategy, threshold):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    monkeypatch.setattr(similarity, "BLOCK_PAIRS", 50)
    monkeypatch.setattr(similarity, "TILE_PAIRS", 64)
    monkeypatch.setattr(similarity, "MAX_BROADCAST_HOT_KEYS", 0)
    s = _copies(spark)
    window = dict(size="size", size_tolerance_pct=50.0)
    want = pair_search(s, s, 256, threshold, "id", "id", strategy="broadcast", **window).collect()
    pairs = pair_search(s, s, 256, threshold, "id", "id", strategy=strategy, max_broadcast_refs=7, **window)
    assert "MapInArrow" in _plan(pairs) and "Broadcast" not in _plan(pairs)
    assert want and sorted(map(str, pairs.collect())) == sorted(map(str, want))


def test_banded_row_does_the_whole_join():
    sql = oracle.oracle_sql()
    assert sql["batch_search_banded"] == sql["batch_search_metric"] == sql["batch_search_chunked"]
    assert "planted" not in str(catalog.q_batch_search_banded.__code__.co_names)


def test_references_of_a_window_meet_their_candidates_in_one_bucket(spark):
    sizes = [*range(-3, 60), 10 ** 6, 2 ** 40 + 1, 2 ** 52 - 1]
    for tolerance in (0.0, 10.0, 50.0, 99.0):
        low, high = _referring_sizes(F.col("size"), tolerance)
        rows = spark.createDataFrame([(x,) for x in sizes], "size long").select(
            "size", size_bucket(F.col("size")).alias("own"), size_bucket(low).alias("low"), size_bucket(high).alias("high")).collect()
        for r in rows:
            lo, hi = size_bounds(r["size"], tolerance)
            for c in rows:
                if lo <= c["size"] <= hi:
                    assert c["low"] <= r["own"] <= c["high"], (tolerance, r, c)


def test_windowed_references_are_not_copied_by_bucket(spark, monkeypatch):
    taken = {}
    whole = similarity._banded_join
    monkeypatch.setattr(similarity, "_banded_join", lambda r, *a: taken.update(r=r) or whole(r, *a))
    s = _copies(spark)
    pair_search(s, s, 256, 90.0, "id", "id", strategy="banded", size="size", size_tolerance_pct=50.0)
    assert taken["r"].count() <= s.where("bits IS NOT NULL").count()


def test_stacks_are_bounded_by_their_grids(monkeypatch):
    sizes, resize = [], images.resize_luminance
    monkeypatch.setattr(images, "resize_luminance", lambda lum, *a: sizes.append(math.prod((len(lum), *a))) or resize(lum, *a))
    rng = np.random.default_rng(2)
    pictures = [(8, 8, 1, rng.integers(0, 256, 64, dtype=np.uint8).tobytes()) for _ in range(300)]
    grids = images.picture_grids(pictures, "perceptual", 16)
    assert max(sizes) <= images.STACK_CELLS
    for i in (0, 127, 128, 299):
        assert grids[i] == images.picture_grid(*pictures[i], "perceptual", 16)
