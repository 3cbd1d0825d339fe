"""Bit columns against plain Python: packing, hex, Hamming, similarity."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.functions.bits import (
    bits_to_hex,
    hamming,
    hamming_to_literal,
    hex_to_bits,
    max_distance,
    pack_bits,
    similarity_pct,
    similarity_value,
    words_to_python_bits,
)

SIZES = [9, 16, 49, 63, 64, 65, 100, 128, 256, 1024]


def _py_hex(bits: str) -> str:
    width = (len(bits) + 3) // 4
    return format(int(bits, 2), f"0{width}x")


@pytest.mark.parametrize("n", SIZES)
def test_pack_hex_roundtrip(spark, n):
    rng = random.Random(n)
    rows = [[rng.random() < 0.5 for _ in range(n)] for _ in range(20)]
    rows.append([True] * n)
    rows.append([False] * n)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, flags array<boolean>")
    out = (df.withColumn("bits", pack_bits(F.col("flags"), n))
             .withColumn("hex", bits_to_hex(F.col("bits"), n))
             .withColumn("back", hex_to_bits(F.col("hex"), n))
             .orderBy("id").collect())
    for r, flags in zip(out, rows):
        expected = "".join("1" if b else "0" for b in flags)
        assert words_to_python_bits(r["bits"], n) == expected
        assert r["hex"] == _py_hex(expected)
        assert list(r["back"]) == list(r["bits"])


@pytest.mark.parametrize("n", [9, 64, 100, 256])
def test_hamming_matches_python(spark, n):
    rng = random.Random(7 * n)
    a = [[rng.random() < 0.5 for _ in range(n)] for _ in range(15)]
    b = [[rng.random() < 0.5 for _ in range(n)] for _ in range(15)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, b))],
                               "id int, fa array<boolean>, fb array<boolean>")
    df = df.withColumn("a", pack_bits(F.col("fa"), n)).withColumn("b", pack_bits(F.col("fb"), n))
    ref = df.orderBy("id").first()["b"]
    out = df.select("id", hamming(F.col("a"), F.col("b"), n).alias("d"),
                    hamming(F.col("a"), F.col("a"), n).alias("self"),
                    hamming(F.col("b"), F.col("a"), n).alias("sym"),
                    hamming_to_literal(F.col("a"), list(ref)).alias("to_ref")).orderBy("id").collect()
    for r, x, y in zip(out, a, b):
        assert r["d"] == sum(p != q for p, q in zip(x, y))
        assert r["self"] == 0
        assert r["sym"] == r["d"]
        assert r["to_ref"] == sum(p != q for p, q in zip(x, b[0]))


@pytest.mark.parametrize("n", [25, 49, 64, 256])
def test_threshold_bound_equals_direct_filter(spark, n):
    df = spark.range(0, n + 1).select(F.col("id").cast("int").alias("d"))
    for t in [-5, 0, 31.99, 32, 50, 60, 89.9, 90, 99, 100, 100.5]:
        direct = {r["d"] for r in df.where(similarity_pct(F.col("d"), n) >= t).collect()}
        bound = max_distance(t, n)
        assert direct == set(range(0, bound + 1)), (n, t)
        assert all(similarity_value(d, n) >= t for d in direct)


def test_similarity_floor_and_rounding(spark):
    row = spark.createDataFrame([(17, 25), (300, 256)], "d int, n int").select(
        similarity_pct(F.col("d"), F.col("n")).alias("s")).collect()
    assert row[0]["s"] == (1.0 - 17 / 25) * 100.0
    assert row[1]["s"] == 0.0


def test_literal_arrays_are_exact(spark):
    import math

    from sightline.functions.bits import double_array, int_array, struct_array

    values = [0.0, -0.5, 1 / 3, math.cos(math.pi / 2), -1e-300, 6.02e23, 0.1 + 0.2]
    row = spark.range(1).select(
        double_array(values).alias("d"), int_array([3, -7, 0]).alias("i"),
        struct_array([(1, 2), (3, 4)], ("a", "b")).alias("s")).first()
    assert list(row["d"]) == values
    assert list(row["i"]) == [3, -7, 0]
    assert [(r["a"], r["b"]) for r in row["s"]] == [(1, 2), (3, 4)]
