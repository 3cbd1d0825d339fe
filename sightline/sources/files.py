"""File listing as a DataFrame.

``binaryFile`` with ``recursiveFileLookup`` lists every file under a root;
selecting only ``length`` and ``modificationTime`` leaves the bytes unread.
Filters on ``_metadata.file_path`` and ``length`` are evaluated against the
file index, so files that fail them are never opened.

Differences from a plain directory walk: Spark's listing skips names that
start with '.' or '_' (files and folders).  The search resolves links of its
two paths (``resolved``); links deeper in the tree are listed as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sightline.functions.text import IMAGE_EXTENSIONS, is_image_path


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def literal_path(path: str) -> str:
    """``path`` as a reader argument that means this one path: readers expand
    glob characters, so each is escaped."""
    return "".join("\\" + c if c in "\\*?[]{}" else c for c in path)


def resolved(spark: SparkSession, path: str) -> str:
    """``path`` with symbolic links resolved when it is on the driver's local
    file system; other paths as given."""
    import os

    fs, p = _hadoop_fs(spark, path)
    if fs.getUri().getScheme() != "file":
        return path
    return os.path.realpath(p.toUri().getPath())


def path_kind(spark: SparkSession, path: str) -> str | None:
    """'file', 'dir' or None (missing), through the cluster's file system."""
    fs, p = _hadoop_fs(spark, path)
    if not fs.exists(p):
        return None
    return "dir" if fs.getFileStatus(p).isDirectory() else "file"


def qualified_uri(spark: SparkSession, path: str) -> str:
    """The URI text Spark's file sources use in ``_metadata.file_path`` for
    ``path``: the file system's own path re-parsed, so a local path reads
    'file:/a/my%20dir' (no empty authority) and others keep theirs."""
    fs, p = _hadoop_fs(spark, path)
    own = fs.getFileStatus(p).getPath().toString()
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own).toUri().toString()


def qualified_path(spark: SparkSession, path: str) -> str:
    """``path`` with its file system's scheme, whether or not it exists."""
    fs, p = _hadoop_fs(spark, path)
    return fs.makeQualified(p).toString()


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder (of few entries); none if there is no such folder."""
    fs, p = _hadoop_fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def remove_files(spark: SparkSession, uris: list[str]) -> None:
    """Delete files by the URIs that Spark reports, through their file system."""
    jvm = spark.sparkContext._jvm
    for uri in uris:
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, False)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this engine wrote, with what is in it."""
    fs, p = _hadoop_fs(spark, path)
    fs.delete(p, True)


def path_mtime(spark: SparkSession, path: str):
    """Modification time of a file or folder as a UTC datetime (None when
    missing), through the cluster's file system."""
    import datetime

    fs, p = _hadoop_fs(spark, path)
    if not fs.exists(p):
        return None
    ms = fs.getFileStatus(p).getModificationTime()
    return datetime.datetime.fromtimestamp(ms / 1000.0, tz=datetime.timezone.utc).replace(tzinfo=None)


def list_files(spark: SparkSession, root: str,
               extensions=IMAGE_EXTENSIONS) -> DataFrame:
    """``file_uri, size, mtime`` for every picture file under ``root``."""
    try:
        raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .load(literal_path(root)))
    except AnalysisException as e:
        raise FileNotFoundError(f"search directory not found: {root}") from e
    files = raw.select(F.col("_metadata.file_path").alias("file_uri"),
                       F.col("length").alias("size"),
                       F.col("modificationTime").alias("mtime"))
    if extensions is None:
        return files
    return files.where(is_image_path(F.col("file_uri"), extensions))


def candidate_filter(file_uri: Column, size: Column, exclude_uri: str | None,
                     bounds: tuple[int, int] | None) -> Column:
    """P2 (not the reference itself) and P3 (inclusive size window)."""
    cond = F.lit(True)
    if exclude_uri is not None:
        cond = cond & (file_uri != F.lit(exclude_uri))
    if bounds is not None:
        cond = cond & size.between(int(bounds[0]), int(bounds[1]))
    return cond
