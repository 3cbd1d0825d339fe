"""Perceptual hash generators over luminance grids.

A grid is ``ARRAY<DOUBLE>``, row-major, ``side_h`` rows of ``side_w`` values.
Each algorithm turns a grid into ``hash_size * hash_size`` row-major flags
with array higher-order functions, so the work stays on the JVM and scales
with the number of rows, one task per input split:

* average     bit = value > mean of the ``k x k`` grid
* difference  bit = right neighbour > left, on ``k`` rows of ``k + 1``
* perceptual  2-D DCT-II of an ``N x N`` grid, low ``k x k`` block,
              bit = coefficient > median of the block
* wavelet     Haar LL band at ``k x k`` = block sums of ``N/k`` squares;
              dropping the coarsest LL only shifts every value by the same
              amount, so bit = block sum > median of the block sums

Positive scale factors (the DCT's 2 per axis, Haar's 1/2 per level) leave a
``>`` comparison unchanged and are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.bits import (
    bits_to_hex,
    double_array,
    int_array,
    let,
    pack_bits,
    struct_array,
)


def _median(values: Column, count: int) -> Column:
    s = F.sort_array(values)
    if count % 2:
        return s.getItem(count // 2)
    return (s.getItem(count // 2 - 1) + s.getItem(count // 2)) / F.lit(2.0)


def _above_median(values: Column, count: int) -> Column:
    # values and their median are each computed once per row
    return let(values, lambda c: let(_median(c, count),
                                     lambda m: F.transform(c, lambda x: x > m)))


def average_flags(grid: Column, k: int, side_h: int, side_w: int) -> Column:
    if (side_h, side_w) != (k, k):
        raise ValueError(f"average hash needs a {k}x{k} grid, got {side_h}x{side_w}")
    total = F.aggregate(grid, F.lit(0.0), lambda acc, x: acc + x)
    return let(total / F.lit(float(k * k)), lambda mean: F.transform(grid, lambda x: x > mean))


def difference_flags(grid: Column, k: int, side_h: int, side_w: int) -> Column:
    if side_w != k + 1 or side_h < k:
        raise ValueError(f"difference hash needs {k} rows of {k + 1}, got {side_h}x{side_w}")
    w = k + 1
    # left-neighbour index of every bit, as literals
    lefts = int_array([(b // k) * w + b % k for b in range(k * k)])
    return F.transform(lefts, lambda left: grid[left + 1] > grid[left])


def dct_basis(k: int, n: int) -> list[float]:
    """Row-major ``k x n`` DCT-II basis, cos(pi * u * (2i + 1) / (2n))."""
    return [math.cos(math.pi * u * (2 * i + 1) / (2 * n)) for u in range(k) for i in range(n)]


def perceptual_coefficients(grid: Column, k: int, n: int) -> Column:
    """Low ``k x k`` DCT-II block of an ``n x n`` grid, separable: first
    ``T = C X`` (k x n), then ``T C^T`` (k x k)."""
    basis = double_array(dct_basis(k, n))
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    # The loops run over literal index arrays, so no element pays for index
    # arithmetic: (basis row offset, grid column) per T cell, then (T row
    # offset, basis row offset) per coefficient.
    t_index = struct_array([(u * n, j) for u in range(k) for j in range(n)], ("b", "j"))
    t = F.transform(t_index, lambda c: F.aggregate(
        steps, F.lit(0.0), lambda acc, i: acc + basis[c.b + i] * grid[i * n + c.j]))
    c_index = struct_array([(u * n, v * n) for u in range(k) for v in range(k)], ("t", "b"))

    def block(tt: Column) -> Column:
        return F.transform(c_index, lambda c: F.aggregate(
            steps, F.lit(0.0), lambda acc, j: acc + tt[c.t + j] * basis[c.b + j]))

    return let(t, block)


def perceptual_flags(grid: Column, k: int, side_h: int, side_w: int) -> Column:
    if side_h != side_w or side_h < k:
        raise ValueError(f"perceptual hash needs a square grid of at least {k}, got {side_h}x{side_w}")
    return _above_median(perceptual_coefficients(grid, k, side_h), k * k)


def wavelet_blocks(grid: Column, k: int, n: int) -> Column:
    b = n // k
    if b == 1:
        return grid
    # grid indices of every block's cells, as literals
    blocks = F.expr("array(" + ", ".join(
        "array(" + ", ".join(str(((q // k) * b + t // b) * n + (q % k) * b + t % b)
                             for t in range(b * b)) + ")"
        for q in range(k * k)) + ")")
    return F.transform(blocks, lambda cells: F.aggregate(
        cells, F.lit(0.0), lambda acc, c: acc + grid[c]))


def wavelet_flags(grid: Column, k: int, side_h: int, side_w: int) -> Column:
    if k & (k - 1):
        raise ValueError(f"wavelet hash size must be a power of two, got {k}")
    if side_h != side_w or side_h % k or side_h & (side_h - 1):
        raise ValueError(f"wavelet hash needs a power-of-two square grid divisible by {k}")
    return _above_median(wavelet_blocks(grid, k, side_h), k * k)


@dataclass(frozen=True)
class Algorithm:
    name: str
    flags: Callable[[Column, int, int, int], Column]
    # grid (rows, cols) a picture is resized to before hashing, given the
    # hash size and the picture's own height and width
    grid_shape: Callable[[int, int, int], tuple[int, int]]


def _wavelet_scale(k: int, h: int, w: int) -> int:
    natural = 2 ** int(math.log2(max(1, min(h, w))))
    return max(natural, k)


# Algorithm registry (X1).  Names are fixed values shared with stored tables.
ALGORITHMS: dict[str, Algorithm] = {
    "average": Algorithm("average", average_flags, lambda k, h, w: (k, k)),
    "perceptual": Algorithm("perceptual", perceptual_flags, lambda k, h, w: (4 * k, 4 * k)),
    "difference": Algorithm("difference", difference_flags, lambda k, h, w: (k, k + 1)),
    "wavelet": Algorithm("wavelet", wavelet_flags,
                         lambda k, h, w: (_wavelet_scale(k, h, w),) * 2),
}


def get_algorithm(name: str) -> Algorithm:
    try:
        return ALGORITHMS[str(name)]
    except KeyError:
        raise ValueError(f"unknown hash algorithm {name!r}; "
                         f"choose one of {sorted(ALGORITHMS)}") from None


def validate_hash_size(algorithm: str, hash_size: int) -> None:
    get_algorithm(algorithm)
    if int(hash_size) != hash_size or hash_size < 2:
        raise ValueError(f"hash size must be an integer >= 2, got {hash_size}")
    if algorithm == "wavelet" and hash_size & (hash_size - 1):
        raise ValueError(f"wavelet hash size must be a power of two, got {hash_size}")


# Algorithms whose grid may arrive already reduced to the k x k values that
# are compared with their median (DCT block, Haar LL band).
MEDIAN_ALGORITHMS = ("perceptual", "wavelet")


def signature_bits(grid: Column, algorithm: str, hash_size: int,
                   side_h: int, side_w: int, reduced: bool = False) -> Column:
    """Grid -> packed signature words (``hash_size**2`` bits).  With
    ``reduced`` the grid already holds the ``k x k`` values a perceptual or
    wavelet hash compares with their median."""
    validate_hash_size(algorithm, hash_size)
    if reduced:
        if algorithm not in MEDIAN_ALGORITHMS or (side_h, side_w) != (hash_size, hash_size):
            raise ValueError(f"a reduced grid must be {hash_size}x{hash_size} for "
                             f"{MEDIAN_ALGORITHMS}")
        flags = _above_median(grid, hash_size * hash_size)
    else:
        flags = get_algorithm(algorithm).flags(grid, hash_size, side_h, side_w)
    return pack_bits(flags, hash_size * hash_size)


def with_signature(df: DataFrame, grid_col: str, algorithm: str, hash_size: int,
                   side_h: int, side_w: int, reduced: bool = False) -> DataFrame:
    """Add ``bits``, ``hash_hex``, ``n_bits``, ``algorithm``, ``hash_size``
    (H6).  Rows whose grid is NULL (undecodable pictures) get NULL bits."""
    n_bits = hash_size * hash_size
    grid = F.col(grid_col)
    bits = F.when(grid.isNotNull(),
                  signature_bits(grid, algorithm, hash_size, side_h, side_w, reduced))
    return (df.withColumn("bits", bits)
              .withColumns({"hash_hex": bits_to_hex(F.col("bits"), n_bits),
                            "n_bits": F.lit(n_bits),
                            "algorithm": F.lit(algorithm),
                            "hash_size": F.lit(hash_size)}))
