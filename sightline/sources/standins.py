"""The driver's tables read as this engine's inputs.

The test data holds no pictures, so each table stands for one input of the
engine (see FIXTURES.md):

* embeddings  64 floats per row = a decoded picture already reduced to a
              row-major 8 x 8 luminance grid; ``vec_id`` = file, ``label`` =
              folder, stored byte size = 4 bytes per value
* documents   a file listing: ``source`` = root, ``doc_id`` = name,
              ``n_chars`` = byte size
* pages       file names with extensions (``url`` without query/fragment)
* events      versions of stored signatures: key (``user_id``,
              ``event_type``), size = ``value``, mtime = ``ts``
* labels      decode outcome: a row = decoded, no row = failed
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.text import strip_query
from sightline.session import scratch_path, ship_package

GRID_SIDE = 8

# Hash sizes that fit an 8 x 8 grid per algorithm.  Average
# uses the whole grid, difference 7 rows of 8, perceptual the low 4 x 4 DCT
# block of the 8 x 8 grid, wavelet 4 x 4 block sums of 2 x 2 squares.
STANDIN_HASH_SIZE = {"average": 8, "difference": 7, "perceptual": 4, "wavelet": 4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, grid ARRAY<DOUBLE> (8 x 8), file_size BIGINT."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", "label",
        F.transform("embedding", lambda x: x.cast("double")).alias("grid"),
        (F.size("embedding") * 4).cast("bigint").alias("file_size"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root, file_uri, name, size: one row per listed file."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("root"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_uri"),
        F.col("doc_id"),
        F.col("n_chars").cast("bigint").alias("size"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", strip_query(F.col("url")).alias("file_uri"))


def signature_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_type (the key), event_id, size, mtime."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_type", "event_id",
                    F.col("value").alias("size"), F.col("ts").alias("mtime"))


def picture_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, px ARRAY<INT>: each embeddings row as an 8 x 8 8-bit picture,
    values scaled to 0..255 within the row (rounded half up)."""
    e = (table(spark, sf_dir, "embeddings")
         .select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
         .withColumn("lo", F.array_min("v")).withColumn("hi", F.array_max("v")))
    # the range is taken as plain columns first: lambdas that feed a pandas
    # UDF must not refer to outer lambda variables
    px = F.transform("v", lambda x: F.when(F.col("hi") > F.col("lo"), F.round(
        (x - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255.0)).otherwise(F.lit(0.0)).cast("int"))
    return e.select("vec_id", px.alias("px"))


def encode_png(pixels: np.ndarray) -> bytes:
    """8-bit gray (H x W), RGB (H x W x 3) or RGBA (H x W x 4) -> PNG bytes."""
    px = np.ascontiguousarray(pixels, dtype=np.uint8)
    h, w = px.shape[:2]
    color = 0 if px.ndim == 2 else {3: 2, 4: 6}[px.shape[2]]
    raw = b"".join(b"\x00" + px[r].tobytes() for r in range(h))

    def chunk(tag: bytes, data: bytes) -> bytes:
        return (struct.pack(">I", len(data)) + tag + data
                + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF))

    header = struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header)
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def _arrow_uri(uri: str) -> str:
    return "file://" + uri[len("file:"):] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _picture_writer(folder: str):
    def write(batches):
        import pyarrow.fs as pafs

        fs, top = pafs.FileSystem.from_uri(_arrow_uri(folder))
        made = set()
        for pdf in batches:
            for vid, px, below, prefix in zip(pdf["vec_id"], pdf["px"], pdf["below"], pdf["prefix"]):
                data = encode_png(np.asarray(px, dtype=np.uint8).reshape(GRID_SIDE, GRID_SIDE))
                base = top + below
                if base not in made:
                    fs.create_dir(base, recursive=True)
                    made.add(base)
                final = f"{base}/{prefix}{int(vid)}.png"
                # written under a hidden name, then renamed: a retried or
                # speculative task rewrites the same bytes; listings skip
                # names starting with '.'
                tmp = f"{base}/.{int(vid)}.png.{uuid.uuid4().hex}"
                with fs.open_output_stream(tmp) as out:
                    out.write(data)
                fs.move(tmp, final)
            yield pd.DataFrame({"vec_id": pdf["vec_id"].astype("int64")})
    return write


def write_pictures(spark: SparkSession, sf_dir: str, tree: bool = False, folder: str | None = None,
                   pixels: DataFrame | None = None) -> str:
    """One PNG file per embeddings row (or row of ``pixels``: vec_id, px), written
    by a Spark job into a fresh folder under the shared checkpoint folder (or
    into ``folder``); returns the folder.  As a ``tree``, files lie in folders by
    label and number, and every seventh has a name that readers skip."""
    ship_package(spark)
    folder = folder or scratch_path(spark, f"pictures-{uuid.uuid4().hex}")
    pixels = picture_pixels(spark, sf_dir) if pixels is None else pixels
    if tree:
        labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
        below = F.format_string("/a/deep/tree/label=%d/hundred %d", "label", F.floor(F.col("vec_id") / 100))
        pixels = pixels.join(labels, "vec_id").select(
            "vec_id", "px", below.alias("below"), F.when(F.col("vec_id") % 7 == 6, "_").otherwise("").alias("prefix"))
    else:
        pixels = pixels.select("vec_id", "px", F.lit("").alias("below"), F.lit("").alias("prefix"))
    written = pixels.mapInPandas(_picture_writer(folder), "vec_id bigint")
    written.write.format("noop").mode("overwrite").save()
    return folder
