"""The banded join of large reference tables: rows dealt by half bands."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import similarity
from sightline.operators.similarity import pair_search


def _signatures(spark, n, n_bits=256, seed=4):
    """Near copies around few centres whose neighbouring bits agree, ids that repeat,
    null sizes, keys, signatures and words."""
    rng = np.random.default_rng(seed)
    side, words = int(n_bits ** 0.5), n_bits // 64
    centres = rng.integers(0, 2, (9, side // 2, side // 2)).repeat(2, 1).repeat(2, 2).reshape(9, n_bits)
    rows = []
    for i in range(n):
        b = centres[0 if i % 4 == 0 else i % 9].copy()
        b[rng.choice(n_bits, int(rng.integers(0, n_bits // 16)), replace=False)] ^= 1
        w = np.packbits(b).view(">i8").astype(np.int64).tolist()
        assert len(w) == words
        rows.append((None if i % 90 == 5 else i - i % 40 // 39, None if i % 70 == 9 else [None, *w[1:]] if i % 70 == 11 else w,
                     None if i % 50 == 7 else int(10 ** rng.uniform(0, 5))))
    return spark.createDataFrame(rows, "id long, bits array<bigint>, size long").withColumn(
        "name", F.concat(F.lit("f"), F.col("id").cast("string"))).repartition(3).cache()


def _generated(node):
    """Rows that the plan's explodes made."""
    if node.nodeName().startswith("AdaptiveSparkPlan"):
        return _generated(node.executedPlan())
    if node.nodeName().endswith("QueryStage"):
        return _generated(node.plan())
    own = node.metrics().get("numOutputRows").get().value() if node.nodeName() == "Generate" else 0
    return own + sum(_generated(node.children().apply(i)) for i in range(node.children().size()))


@pytest.mark.parametrize("tolerance", [None, 50.0, 150.0])
@pytest.mark.parametrize("cell_rows", [20, 16_384])
def test_half_bands_equal_nested_loop(spark, monkeypatch, tolerance, cell_rows):
    monkeypatch.setattr(similarity, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(similarity, "CELL_ROWS_PER_TASK", 1_000)
    monkeypatch.setattr(similarity, "TILE_PAIRS", 64)
    s = _signatures(spark, 270)
    window = dict(size="size", size_tolerance_pct=tolerance)
    for refs, key, options in ((s, "name", {}), (s.where("id % 9 = 1"), "id", dict(exclude_self=False))):
        rows = [sorted(map(str, pair_search(refs, s, 256, 90.0, "name", key, strategy=how, **options, **window).collect()))
                for how in ("broadcast", "banded")]
        assert rows[0] and rows[0] == rows[1]


@pytest.mark.parametrize("n_bits,threshold", [(64, 91.0), (64, 100.0), (256, 98.0), (256, 100.0)])
def test_bands_of_any_width(spark, n_bits, threshold):
    """At 98 % of 256 bits a band was wider than a word, which no BIGINT holds."""
    s = _signatures(spark, 200, n_bits)
    s = s.unionByName(s.where("id < 40"))
    rows = [sorted(map(str, pair_search(s, s, n_bits, threshold, "id", "id", exclude_self=False, strategy=how).collect()))
            for how in ("broadcast", "banded")]
    assert rows[0] and rows[0] == rows[1]


def test_rows_are_not_copied_by_flips_or_buckets(spark):
    """Twice a band on either side; a reference used to be copied for each bit."""
    s = _signatures(spark, 300)
    pairs = pair_search(s, s, 256, 90.0, "id", "id", strategy="banded", size="size", size_tolerance_pct=50.0)
    assert pairs.collect()
    assert 0 < _generated(pairs._jdf.queryExecution().executedPlan()) <= 2 * 26 * 300


def test_neighbouring_bits_lie_in_different_bands():
    """So values of half a band share few rows, also where a picture's neighbours agree."""
    for n_bits, d_max in ((256, 25), (64, 6), (49, 4), (1024, 80)):
        layout, side = similarity.band_layout(n_bits, d_max), int(n_bits ** 0.5)
        order = similarity.spread_bits(n_bits, len(layout))
        assert sorted(order) == list(range(n_bits))
        at = {k: i for i, (start, n) in enumerate(layout) for k in order[start:start + n]}
        alike = [at[k] == at[k + step] for k in range(n_bits - side) for step in (1, side)]
        assert sum(alike) < len(alike) / 10
