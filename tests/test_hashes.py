"""Hash generators on grids against numpy versions of their definitions."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators.hashes import dct_basis, signature_bits, validate_hash_size
from sightline.functions.bits import words_to_python_bits


def _np_bits(grid: np.ndarray, algorithm: str, k: int) -> str:
    """Expected bits; '?' where a value is within rounding of the median
    (summation order may decide those)."""
    if algorithm == "perceptual":
        n = grid.shape[0]
        c = np.array(dct_basis(k, n)).reshape(k, n)
        coef = (c @ grid @ c.T).ravel()
        med = np.median(coef)
        tol = 1e-9 * max(1.0, np.abs(coef).max())
        return "".join("?" if abs(x - med) < tol else ("1" if x > med else "0") for x in coef)
    if algorithm == "average":
        f = grid > grid.mean()
    elif algorithm == "difference":
        g = grid[:k, : k + 1]
        f = g[:, 1:] > g[:, :-1]
    else:
        n = grid.shape[0]
        b = n // k
        blocks = grid.reshape(k, b, k, b).sum(axis=(1, 3))
        f = blocks > np.median(blocks)
    return "".join("1" if x else "0" for x in f.ravel())


CASES = [("average", 8, 8, 8), ("difference", 7, 8, 8), ("difference", 4, 4, 5),
         ("perceptual", 4, 8, 8), ("perceptual", 8, 32, 32), ("wavelet", 4, 8, 8),
         ("wavelet", 8, 32, 32), ("average", 16, 16, 16)]


@pytest.mark.parametrize("algorithm,k,h,w", CASES)
def test_hash_matches_numpy(spark, algorithm, k, h, w):
    rng = np.random.default_rng(k * 31 + h)
    grids = [rng.integers(0, 256, size=(h, w)).astype(float) for _ in range(12)]
    grids.append(np.linspace(0, 1, h * w).reshape(h, w))
    df = spark.createDataFrame([(i, g.ravel().tolist()) for i, g in enumerate(grids)],
                               "id int, grid array<double>")
    out = df.select("id", signature_bits(F.col("grid"), algorithm, k, h, w).alias("bits")) \
            .orderBy("id").collect()
    for r, g in zip(out, grids):
        got, want = words_to_python_bits(r["bits"], k * k), _np_bits(g, algorithm, k)
        assert all(w in ("?", x) for x, w in zip(got, want)), (got, want)


def test_bad_sizes_rejected():
    with pytest.raises(ValueError):
        validate_hash_size("wavelet", 6)
    with pytest.raises(ValueError):
        validate_hash_size("average", 1)
    with pytest.raises(ValueError):
        validate_hash_size("nope", 8)
