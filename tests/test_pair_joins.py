"""The pair joins of large reference tables: size buckets and metric cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import similarity
from sightline.operators.similarity import _metric_join, choose_pivots, pair_search, size_bucket


def _signatures(spark, n, groups, flips, seed=1):
    """``n`` 256-bit signatures around ``groups`` centres, one centre with a third
    of all rows; sizes with zeros, nulls and a wide range."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2, (groups, 256))
    rows = []
    for i in range(n):
        b = centres[0 if i % 3 == 0 else i % groups].copy()
        b[rng.choice(256, rng.integers(0, flips + 1), replace=False)] ^= 1
        words = np.packbits(b).view(">i8").astype(np.int64).tolist()
        rows.append((i, words, None if i % 50 == 7 else int(10 ** rng.uniform(0, 6)) if i % 11 else 0))
    return spark.createDataFrame(rows, "id long, bits array<bigint>, size long").repartition(4).cache()


def _plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.mark.parametrize("threshold", [65.0, 80.0, 92.0])
@pytest.mark.parametrize("tolerance", [None, 0.0, 50.0, 150.0])
def test_joins_equal_broadcast(spark, threshold, tolerance):
    s = _signatures(spark, 240, 12, 30)
    window = dict(size="size", size_tolerance_pct=tolerance)
    want = pair_search(s, s, 256, threshold, "id", "id", strategy="broadcast", **window).collect()
    assert want or tolerance == 0.0
    for strategy, hot in (("metric", 100_000), ("metric", 10), *([("banded", 10)] if threshold == 92.0 else [])):
        got = pair_search(s, s, 256, threshold, "id", "id", strategy=strategy, hot_band_rows=hot, **window).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)), strategy


def test_engine_chooses_without_nested_loop(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MAX_NESTED_REFS", 100)
    s = _signatures(spark, 300, 12, 10)
    for threshold, window in ((92.0, {}), (92.0, dict(size="size", size_tolerance_pct=50.0)),
                              (65.0, dict(size="size", size_tolerance_pct=50.0))):
        pairs = pair_search(s, s, 256, threshold, "id", "id", **window)
        plan = _plan(pairs)
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert ("_bucket" in plan) == bool(window)
        want = pair_search(s, s, 256, threshold, "id", "id", strategy="broadcast", **window)
        assert sorted(map(str, pairs.collect())) == sorted(map(str, want.collect()))


def test_buckets_rise_with_size(spark):
    rows = spark.range(0, 5000).select(F.col("id").alias("size"), size_bucket(F.col("id")).alias("b")).collect()
    found = [r["b"] for r in sorted(rows)]
    assert found == sorted(found) and found[0] == found[1] == 0


def test_metric_cells_narrow_clustered_signatures(spark):
    """Signatures around far centres: a cell's references are few."""
    s = _signatures(spark, 600, 40, 6, seed=3)
    r, c = (s.select(F.col("id").alias(i), F.col("bits").alias(b)) for i, b in (("reference", "_rbits"), ("candidate", "_cbits")))
    assert 1 < len(choose_pivots(s.select(F.col("bits").alias("_bits")), 256, 32)) <= 32
    taken = []
    whole = similarity._salted_join
    try:
        similarity._salted_join = lambda *a: taken.append(whole(*a)) or taken[-1]
        found = _metric_join(r, c, 256, 20).count()
    finally:
        similarity._salted_join = whole
    verified = taken[0].count()
    assert found <= verified < 600 * 600 / 3


def test_empty_sides(spark):
    s = _signatures(spark, 30, 3, 3)
    for refs, cands in ((s.limit(0), s), (s, s.limit(0))):
        for strategy in ("metric", "banded", None):
            assert pair_search(refs, cands, 256, 95.0, "id", "id", strategy=strategy, size="size", size_tolerance_pct=50.0).count() == 0
