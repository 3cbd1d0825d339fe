"""Pictures decoded by Spark and reduced to luminance grids (S3, H5).

Spark's ``image`` source decodes files inside the scan tasks (Java ImageIO)
and yields ``origin, height, width, nChannels, mode, data`` with pixels in
BGR(A) order; a file it cannot decode gives height -1 and empty data, which
is this engine's "failed" outcome (``dropInvalid`` stays off).

The grid step is the one place Python runs: a pandas UDF, fed by Arrow in
small batches because each row carries a whole decoded picture, converts to
8-bit luminance and resizes exactly as the common imaging library does for
8-bit images — ``L = (19595 R + 38470 G + 7471 B + 32768) >> 16``, then a
two-pass Lanczos-3 resample (horizontal, then vertical) with weights in
22-bit fixed point and rounding to 8 bits after each pass.  Sums are exact
integers, so the result does not depend on summation order.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from sightline.functions.text import IMAGE_EXTENSIONS, is_image_path
from sightline.operators.hashes import (
    MEDIAN_ALGORITHMS,
    dct_basis,
    get_algorithm,
    validate_hash_size,
    with_signature,
)
from sightline.session import ship_package
from sightline.sources.files import literal_path

IMAGE_STRUCT = T.StructType([
    T.StructField("origin", T.StringType(), True),
    T.StructField("height", T.IntegerType(), True),
    T.StructField("width", T.IntegerType(), True),
    T.StructField("nChannels", T.IntegerType(), True),
    T.StructField("mode", T.IntegerType(), True),
    T.StructField("data", T.BinaryType(), True),
])
IMAGE_SCHEMA = T.StructType([T.StructField("image", IMAGE_STRUCT, True)])

# Arrow batch limits for the grid UDF: many thumbnails or a few large photos.
BATCH_BYTES = 64 << 20
BATCH_ROWS = 1024

# Older files than this count as seen: beyond the age of any file.
MAX_FILE_AGE = "36500d"

# 8-bit luminance weights of R, G, B in 16.16 fixed point with
# rounding; resampling filter support (Lanczos-3) and weight precision bits.
LUMA_WEIGHTS = (19595, 38470, 7471)
LUMA_ROUND = 0x8000
_LANCZOS_SUPPORT = 3.0
_PRECISION_BITS = 22  # 32 - 8 - 2


def _metadata_columns(df: DataFrame) -> DataFrame:
    return df.select(F.col("_metadata.file_path").alias("file_uri"),
                     F.col("_metadata.file_size").alias("size"),
                     F.col("_metadata.file_modification_time").alias("mtime"),
                     "image")


def read_images(spark: SparkSession, paths: str | list[str], recursive: bool = True,
                extensions=IMAGE_EXTENSIONS) -> DataFrame:
    """``file_uri, size, mtime, image`` for pictures at ``paths`` (a root or a
    list of files).  Extension and any later ``_metadata`` filters prune
    files before they are decoded."""
    reader = spark.read.format("image").option("dropInvalid", "false")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    try:
        named = [paths] if isinstance(paths, str) else list(paths)
        df = reader.load([literal_path(p) for p in named])
    except AnalysisException as e:
        raise FileNotFoundError(str(paths)) from e
    out = _metadata_columns(df)
    if extensions is not None:
        out = out.where(is_image_path(F.col("file_uri"), extensions))
    return out


def image_stream(spark: SparkSession, root: str, files_per_batch: int = 500,
                 extensions=IMAGE_EXTENSIONS) -> DataFrame:
    """Streaming form of ``read_images``: new files under ``root``, however old
    their modification time is (copied pictures keep theirs).  The price is
    that the source's log keeps every path it has seen."""
    df = (spark.readStream.format("image").schema(IMAGE_SCHEMA)
          .option("dropInvalid", "false").option("recursiveFileLookup", "true")
          .option("maxFilesPerTrigger", int(files_per_batch))
          .option("maxFileAge", MAX_FILE_AGE).load(literal_path(root)))
    out = _metadata_columns(df)
    if extensions is not None:
        out = out.where(is_image_path(F.col("file_uri"), extensions))
    return out


# -- luminance and resampling (numpy, per picture) ---------------------------

def _lanczos(x: np.ndarray) -> np.ndarray:
    """sinc(x) sinc(x / 3) inside the support, element by element (``math.sin``,
    whose last bit the weights depend on)."""
    def sinc(v: float) -> float:
        return 1.0 if v == 0.0 else math.sin(v * math.pi) / (v * math.pi)

    kernel = [sinc(v) * sinc(v / 3) if -_LANCZOS_SUPPORT <= v < _LANCZOS_SUPPORT else 0.0 for v in x.ravel()]
    return np.array(kernel).reshape(x.shape)


@lru_cache(maxsize=256)
def resample_weights(in_size: int, out_size: int) -> tuple[np.ndarray, np.ndarray]:
    """(taps, weights): for every output position the input indices and
    fixed-point weights (both one row per output; padding taps weigh 0).

    An output's centre lies at ``(o + 0.5) * scale``; the kernel, stretched by
    the scale when shrinking, weighs the inputs within its support, and the
    weights are normalised and rounded away from zero to fixed point."""
    scale = in_size / out_size
    stretch = max(scale, 1.0)
    reach = _LANCZOS_SUPPORT * stretch
    centre = (np.arange(out_size) + 0.5) * scale
    low = np.maximum(np.trunc(centre - reach + 0.5), 0).astype(np.int64)
    high = np.minimum(np.trunc(centre + reach + 0.5), in_size).astype(np.int64)
    taps = low[:, None] + np.arange(int((high - low).max()))
    inside = taps < high[:, None]
    at = (taps - centre[:, None] + 0.5) * (1.0 / stretch)
    kernel = np.where(inside, _lanczos(at), 0.0)
    total = np.zeros(out_size)
    for column in kernel.T:  # in input order, as the fixed-point weights are defined
        total += column
    kernel = np.divide(kernel, total[:, None], out=kernel, where=total[:, None] != 0)
    fixed = kernel * float(1 << _PRECISION_BITS)
    weights = np.trunc(fixed + np.where(fixed < 0, -0.5, 0.5)).astype(np.int64)
    return np.where(inside, taps, 0), np.where(inside, weights, 0)


# Dense weight matrices kept by a worker, oldest out first.
DENSE_CACHE_BYTES = 64 << 20
_dense: dict[tuple[int, int], np.ndarray] = {}


def _dense_weights(in_size: int, out_size: int) -> np.ndarray:
    """The same weights as an ``in_size x out_size`` float64 matrix, cached
    up to ``DENSE_CACHE_BYTES``."""
    key = (in_size, out_size)
    if key not in _dense:
        _dense[key] = _make_dense(in_size, out_size)
        while len(_dense) > 1 and sum(m.nbytes for m in _dense.values()) > DENSE_CACHE_BYTES:
            _dense.pop(next(iter(_dense)))
    return _dense[key]


def _make_dense(in_size: int, out_size: int) -> np.ndarray:
    taps, weights = resample_weights(in_size, out_size)
    dense = np.zeros((in_size, out_size), dtype=np.float64)
    for o in range(out_size):
        np.add.at(dense[:, o], taps[o], weights[o])
    return dense


# Pictures of one size stacked at once, in pixels.
STACK_PIXELS = 4 << 20
# Cells of the resized grids of pictures stacked at once: doubles, in a few copies.
STACK_CELLS = 1 << 19

# Outputs up to this wide are resampled with a dense matrix product.
_DENSE_MAX_OUT = 256


def _resample_rows(img: np.ndarray, out_w: int) -> np.ndarray:
    """Resample the last axis of uint8 rows (any leading axes) to ``out_w``.

    Products and sums are integers below 2**53, so a float64 matrix product
    (BLAS) is exact and equals the tap-by-tap integer sum; it is used for
    the small outputs hashes need, the gathered form for large ones."""
    w = img.shape[-1]
    rows = img.reshape(-1, w)
    out = np.empty((len(rows), out_w), dtype=np.uint8)
    half = 1 << (_PRECISION_BITS - 1)
    if out_w <= _DENSE_MAX_OUT:
        dense = _dense_weights(w, out_w)
        chunk = max(1, (1 << 20) // max(w, out_w, 1))
        for r0 in range(0, len(rows), chunk):
            acc = (rows[r0:r0 + chunk].astype(np.float64) @ dense).astype(np.int64) + half
            out[r0:r0 + chunk] = np.clip(acc >> _PRECISION_BITS, 0, 255)
    else:
        taps, weights = resample_weights(w, out_w)
        per_row = out_w * taps.shape[1]
        chunk = max(1, (8 << 20) // max(per_row, 1))
        for r0 in range(0, len(rows), chunk):
            block = rows[r0:r0 + chunk].astype(np.int64)
            acc = (block[:, taps] * weights).sum(axis=2) + half
            out[r0:r0 + chunk] = np.clip(acc >> _PRECISION_BITS, 0, 255)
    return out.reshape(*img.shape[:-1], out_w)


def resize_luminance(lum: np.ndarray, out_h: int, out_w: int) -> np.ndarray:
    """Two-pass 8-bit Lanczos resize of uint8 pictures (height and width are the
    last axes, so pictures of one size may be stacked)."""
    h, w = lum.shape[-2:]
    cur = lum
    if out_w != w:
        cur = _resample_rows(cur, out_w)
    if out_h != h:
        cur = np.swapaxes(_resample_rows(np.ascontiguousarray(np.swapaxes(cur, -1, -2)), out_h), -1, -2)
    return np.ascontiguousarray(cur)


def luminance(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """8-bit luminance of Spark image bytes (gray, BGR or BGRA)."""
    return stacked_luminance(height, width, channels, [data])[0]


def stacked_luminance(height: int, width: int, channels: int, pictures: list[bytes]) -> np.ndarray:
    """8-bit luminance of pictures of one size (pictures x height x width).  The
    weighted sum fits 32 bits; pixels go in chunks so a large photo needs a few
    MB of temporaries, not several copies of itself."""
    out = np.empty((len(pictures), height * width), dtype=np.uint8)
    wr, wg, wb = (np.uint32(w) for w in LUMA_WEIGHTS)
    step = 4 << 20
    for lum, data in zip(out, pictures):
        px = np.frombuffer(data, dtype=np.uint8)
        if channels == 1:
            lum[:] = px
            continue
        px = px.reshape(-1, channels)
        for p0 in range(0, len(px), step):
            blk = px[p0:p0 + step]
            acc = blk[:, 2].astype(np.uint32) * wr
            acc += blk[:, 1].astype(np.uint32) * wg
            acc += blk[:, 0].astype(np.uint32) * wb
            acc += np.uint32(LUMA_ROUND)
            lum[p0:p0 + step] = acc >> 16
    return out.reshape(-1, height, width)


@lru_cache(maxsize=64)
def _dct_matrix(k: int, n: int) -> np.ndarray:
    return np.array(dct_basis(k, n)).reshape(k, n)


def picture_grid(height: int, width: int, channels: int, data: bytes,
                 algorithm: str, hash_size: int) -> list[float] | None:
    """The grid an algorithm hashes, row-major; None when undecodable."""
    return picture_grids([(height, width, channels, data)], algorithm, hash_size)[0]


def picture_grids(pictures: list[tuple], algorithm: str, hash_size: int) -> list[list[float] | None]:
    """The grids of (height, width, channels, data) pictures, row-major; None
    where undecodable.  Pictures of one size are stacked, up to ``STACK_PIXELS``
    and ``STACK_CELLS`` at once: one resample and one DCT product for each stack.  Perceptual and
    wavelet come back reduced to ``k x k`` (DCT low block, Haar LL block sums)."""
    out: list[list[float] | None] = [None] * len(pictures)
    sizes: dict[tuple, list[int]] = {}
    for i, (h, w, c, data) in enumerate(pictures):
        if h is not None and h > 0 and w > 0 and data:
            sizes.setdefault((int(h), int(w), int(c)), []).append(i)
    for (h, w, c), members in sizes.items():
        rows, cols = get_algorithm(algorithm).grid_shape(hash_size, h, w)
        at_once = max(1, min(STACK_PIXELS // (h * w), STACK_CELLS // (rows * cols)))
        for a in range(0, len(members), at_once):
            part = members[a:a + at_once]
            lum = stacked_luminance(h, w, c, [pictures[i][3] for i in part])
            small = resize_luminance(lum, rows, cols).astype(np.float64)
            if algorithm == "wavelet":
                b = rows // hash_size
                small = small.reshape(-1, hash_size, b, hash_size, b).sum(axis=(2, 4))
            elif algorithm == "perceptual":
                basis = _dct_matrix(hash_size, rows)
                small = basis @ small @ basis.T
            for i, grid in zip(part, small.reshape(len(part), -1).tolist()):
                out[i] = grid
    return out


def grid_side(algorithm: str, hash_size: int) -> tuple[int, int]:
    """Shape of the grid column the UDF emits."""
    if algorithm in MEDIAN_ALGORITHMS:
        return hash_size, hash_size
    return get_algorithm(algorithm).grid_shape(hash_size, 0, 0)


# Session settings for plans that decode pictures, read when such a plan
# runs: Arrow batches into the grid UDF are cut by bytes (each row carries a
# whole decoded picture), and small picture files are packed into splits by
# their size rather than a 4 MB per-file allowance.
PICTURE_CONF = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.files.openCostInBytes": str(256 << 10),
}


@contextmanager
def picture_conf(spark: SparkSession):
    """Apply ``PICTURE_CONF`` while the enclosed actions run, then restore."""
    before = {k: spark.conf.get(k, None) for k in PICTURE_CONF}
    for k, v in PICTURE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def grid_udf(algorithm: str, hash_size: int):
    validate_hash_size(algorithm, hash_size)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def to_grid(height: pd.Series, width: pd.Series, channels: pd.Series,
                data: pd.Series) -> pd.Series:
        grids = []  # a batch's grids as arrays; lists of Python floats for few rows only
        pictures = zip(height, width, channels, data)
        while part := list(islice(pictures, BATCH_ROWS)):
            grids.extend(None if g is None else np.array(g) for g in picture_grids(part, algorithm, hash_size))
        return pd.Series(grids, dtype=object)

    return to_grid


def with_grid(images: DataFrame, algorithm: str, hash_size: int) -> tuple[DataFrame, int, int]:
    """Add ``grid`` (NULL for failed decodes); returns (df, side_h, side_w)."""
    ship_package(images.sparkSession)
    udf = grid_udf(algorithm, hash_size)
    img = F.col("image")
    grid = udf(img.height, img.width, img.nChannels, img.data)
    side_h, side_w = grid_side(algorithm, hash_size)
    return images.withColumn("grid", grid).drop("image"), side_h, side_w


def with_picture_signature(images: DataFrame, algorithm: str, hash_size: int) -> DataFrame:
    """Pictures -> signature columns (S3 -> H5 -> H1..H4 -> F2), dropping the
    pixels and the grid."""
    grid, side_h, side_w = with_grid(images, algorithm, hash_size)
    return with_signature(grid, "grid", algorithm, hash_size, side_h, side_w,
                          reduced=algorithm in MEDIAN_ALGORITHMS).drop("grid")
