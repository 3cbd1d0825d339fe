"""Recursive listing by Spark jobs (S1): no path passes the driver.

The folders still to list are a table.  Each round's tasks list their folders
and go on into the subfolders they meet until ``entries_per_folder`` entries have
been found from one starting folder; what is then unlisted is the next round's
table.  A small tree is one round, a large one spreads over all tasks from its
second round on, and only counts reach the driver.  Rounds are written next to
each other, so a lost executor repeats its tasks of one round only.

Tasks list through Python: the local file system entry by entry, others through
``pyarrow.fs`` by the URI's scheme (object stores, HDFS with its client library).
File systems that only Spark's own readers know are listed by
``files.list_files``, whose file index is on the driver (``supported`` tells).

Spark's readers skip names that start with '.' or '_' (and what lies in folders
named so).  Here they are listed and marked ``hidden``, so that a search can say
how many it could not read.  Linked folders are not entered; linked files are
listed under their own names.
"""

from __future__ import annotations

import os
import stat
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.text import IMAGE_EXTENSIONS, is_image_path, quote_path
from sightline.session import scratch_path, ship_package
from sightline.sources.files import qualified_uri, remove_folder

ENTRIES_PER_FOLDER = 20_000
BATCH_ENTRIES = 5_000
FOLDERS_PER_TASK = 8
# kind: 'file', 'folder' (still to list), 'unreadable' (a folder that could not be
# listed, or a name that is not text)
SCHEMA = "kind string, path string, file_uri string, size long, mtime_ms long, hidden boolean"


@dataclass
class Listing:
    """``files``: file_uri, size, mtime, hidden of every file.  ``n_files`` and
    ``n_hidden`` of them; ``unreadable``: folders that could not be listed."""

    files: DataFrame
    n_files: int
    n_hidden: int
    unreadable: int
    rounds: int
    path: str

    def visible(self, extensions=IMAGE_EXTENSIONS) -> DataFrame:
        """``file_uri, size, mtime`` of the files that readers can open, as
        ``files.list_files`` gives them."""
        out = self.files.where(~F.col("hidden"))
        if extensions is not None:
            out = out.where(is_image_path(F.col("file_uri"), extensions))
        return out.select("file_uri", "size", "mtime")

    def skipped(self, extensions=IMAGE_EXTENSIONS) -> Column:
        """A condition on ``files``: wanted by extension but not readable."""
        wanted = F.lit(True) if extensions is None else is_image_path(F.col("file_uri"), extensions)
        return F.col("hidden") & wanted


def hidden_name(name: str) -> bool:
    """Whether Spark's file index leaves out a name."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def supported(uri: str) -> bool:
    """Whether tasks can list ``uri``: local, or known to ``pyarrow.fs``."""
    scheme = urlparse(uri).scheme
    return scheme in ("", "file") or scheme in ("s3", "s3a", "gs", "gcs", "hdfs", "abfs", "abfss")


def _local_entries(base: str, path: str) -> Iterator[tuple[str, str, int, int]]:
    """(name, kind, size, mtime in ms) of a local folder, as it is read."""
    with os.scandir(base + path) as found:
        for e in found:
            try:
                if e.is_dir(follow_symlinks=False):
                    yield e.name, "folder", 0, 0
                    continue
                s = e.stat()
            except OSError:  # gone meanwhile, or a link to nothing
                continue
            if stat.S_ISREG(s.st_mode):
                yield e.name, "file", s.st_size, s.st_mtime_ns // 1_000_000


def _remote_entries(fs, base: str, path: str) -> Iterator[tuple[str, str, int, int]]:
    from pyarrow.fs import FileSelector, FileType

    for e in fs.get_file_info(FileSelector(base + path)):
        if e.type == FileType.Directory:
            yield e.base_name, "folder", 0, 0
        elif e.type == FileType.File:
            yield e.base_name, "file", e.size, (e.mtime_ns or 0) // 1_000_000


def _lister(root_uri: str):
    """A function of a folder's path below the root that gives its entries."""
    u = urlparse(root_uri)
    if u.scheme in ("", "file"):
        base = unquote(u.path).rstrip("/")
        return lambda path: _local_entries(base, path or "/")
    from pyarrow.fs import FileSystem

    fs, base = FileSystem.from_uri(root_uri)
    return lambda path: _remote_entries(fs, base.rstrip("/"), path)


def _list_folders(root_uri: str, entries_per_folder: int):
    base_uri = root_uri.rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries = _lister(root_uri)
        rows: list[tuple] = []
        table = lambda: pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        for b in batches:
            for start, start_hidden in zip(b["path"], b["hidden"]):
                todo, found = [(start, bool(start_hidden))], 0
                while todo and found < entries_per_folder:
                    folder, in_hidden = todo.pop()
                    try:
                        for name, kind, size, mtime in entries(folder):
                            found += 1
                            path = f"{folder}/{name}"
                            hidden = in_hidden or hidden_name(name)
                            try:
                                path.encode()
                            except UnicodeEncodeError:  # bytes that are no text: no reader could name it
                                rows.append(("unreadable", path.encode("utf-8", "replace").decode(), None, None, None, True))
                                continue
                            if kind == "folder":
                                todo.append((path, hidden))
                            else:
                                rows.append(("file", path, base_uri + quote_path(path), size, mtime, hidden))
                            if len(rows) >= BATCH_ENTRIES:
                                yield table()
                                rows.clear()
                    except OSError:
                        rows.append(("unreadable", folder, None, None, None, in_hidden))
                rows += [("folder", path, None, None, None, hidden) for path, hidden in todo]
        yield table()

    return run


def list_tree(spark: SparkSession, root: str, entries_per_folder: int = ENTRIES_PER_FOLDER) -> Listing:
    """Every file below ``root``, by tasks; the listing is a table below the
    shared checkpoint folder until ``forget`` removes it."""
    ship_package(spark)
    root_uri = qualified_uri(spark, root)
    out = scratch_path(spark, f"listing-{uuid.uuid4().hex}")
    tasks = spark.sparkContext.defaultParallelism
    folders = spark.createDataFrame([("", False)], "path string, hidden boolean").coalesce(1)
    run, rounds = _list_folders(root_uri, entries_per_folder), 0
    totals = {"file": 0, "hidden": 0, "unreadable": 0}
    while True:
        here = f"{out}/round={rounds}"
        folders.mapInPandas(run, SCHEMA).write.parquet(here)
        rounds += 1
        back = spark.read.schema(SCHEMA).parquet(here)
        kind = F.col("kind")
        n = back.agg(*[F.count_if(kind == k).alias(k) for k in ("file", "folder", "unreadable")],
                     F.count_if((kind == "file") & F.col("hidden")).alias("hidden")).first()
        for k in totals:
            totals[k] += n[k]
        if not n["folder"]:
            break
        spread = min(n["folder"], max(tasks, n["folder"] // FOLDERS_PER_TASK))
        folders = back.where(F.col("kind") == "folder").select("path", "hidden").repartition(spread)
    files = spark.read.schema(SCHEMA).parquet(*[f"{out}/round={r}" for r in range(rounds)]).where(F.col("kind") == "file")
    return Listing(files.select("file_uri", "size", F.timestamp_millis("mtime_ms").alias("mtime"), "hidden"),
                   totals["file"], totals["hidden"], totals["unreadable"], rounds, out)


def forget(spark: SparkSession, listing: Listing) -> None:
    """Remove a listing's table."""
    remove_folder(spark, listing.path)
