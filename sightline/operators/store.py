"""Signature store and file inventory as Parquet tables (S4-S7, J1, J2, P4-P6,
U1, U2, A4).

Layout under a store folder:

* ``signatures/algorithm=…/hash_size=…/``  file_uri, size, mtime, hash_hex,
  bits, n_bits, written_at.  Writes append; readers keep the newest row per
  file (``written_at``), so a save never rewrites what is already stored and
  an interrupted save leaves the table as it was (Spark commits at job end).
  ``compact_signatures`` folds a partition back to one row per file.
* ``signatures_by_key/algorithm=…/hash_size=…/buckets=N/``  the same rows as a
  table bucketed and sorted by ``file_uri``, once ``compact_signatures`` was told a
  number of buckets: newest-per-key and the lookup join read it bucket by
  bucket, so the stored side is never shuffled.  Later saves append to it.
* ``signatures_stream/…``  rows that a file sink appended (earlier versions of the
  streaming refresh); read with the rest until ``fold_streamed`` moves them.
* ``inventory/root=…/``  file_uri, size, mtime — the last listing of a root.
* ``inventory_meta/root=…/``  root_mtime, file_count, scanned_at.

"Newest per key" is a grouped ``max`` over a struct that leads with the
ordering columns: it aggregates partially in every task before the shuffle,
so a key holding a third of all rows is reduced map-side, never sorted in
one task.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SIGNATURE_COLUMNS = ["file_uri", "size", "mtime", "hash_hex", "bits", "n_bits"]
# Signature rows are ~100 bytes; this many per file keeps files near 100 MB.
ROWS_PER_FILE = 1_000_000


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per ``key``: the row with the greatest ``order`` tuple; ties
    go to the greatest whole row, so the choice is deterministic.

    The key columns come back as the grouping columns themselves, so the
    aggregate's hash partitioning on them still counts for a following join
    on the same key (no second exchange), and filters on the key can move
    below the aggregate."""
    rest = [c for c in df.columns if c not in key]
    payload = F.struct(*[F.col(c) for c in rest]).alias("_row")
    best = F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], payload))
    out = df.groupBy(*key).agg(best.alias("_best"))
    return out.select(*[F.col(c) if c in key else F.col(f"_best._row.{c}").alias(c)
                        for c in df.columns])


def upsert(existing: DataFrame, updates: DataFrame, key: list[str],
           tiebreak: list[str]) -> DataFrame:
    """Rows of ``updates`` replace rows of ``existing`` with the same key;
    among several updates of one key the greatest ``tiebreak`` wins (S5)."""
    both = (existing.withColumn("_seq", F.lit(0))
            .unionByName(updates.withColumn("_seq", F.lit(1))))
    return latest_per_key(both, key, ["_seq", *tiebreak]).drop("_seq")


def lookup(current: DataFrame, stored: DataFrame, key: list[str],
           size: str = "size", mtime: str = "mtime") -> DataFrame:
    """Current files against stored rows (J1, P4): ``status`` is 'hit' when
    size and mtime both equal the stored ones, 'stale' when a stored row
    differs, 'miss' when none exists.  Stored columns come back prefixed
    ``stored_``."""
    s = stored.select(*key, *[F.col(c).alias(f"stored_{c}") for c in stored.columns if c not in key])
    j = current.join(s, key, "left")
    fresh = (F.col(f"stored_{size}") == F.col(size)) & (F.col(f"stored_{mtime}") == F.col(mtime))
    status = (F.when(F.col(f"stored_{size}").isNull() & F.col(f"stored_{mtime}").isNull(), "miss")
               .when(fresh, "hit").otherwise("stale"))
    return j.withColumn("status", status)


def misses(current: DataFrame, stored: DataFrame, key: list[str],
           size: str = "size", mtime: str = "mtime") -> DataFrame:
    """Current files with no fresh stored row (J2): stale rows count as
    missing.  ``stored`` holds one row per key (as ``latest_per_key`` and
    ``read_signatures`` give), so this is the left join of ``lookup`` on the
    key alone, which reuses a key partitioning both sides already have."""
    looked = lookup(current, stored.select(*key, size, mtime), key, size, mtime)
    return looked.where(F.col("status") != "hit").select(*current.columns)


def hits(current: DataFrame, stored: DataFrame, key: list[str],
         size: str = "size", mtime: str = "mtime") -> DataFrame:
    """Current files whose stored row is fresh, with the stored columns
    (``stored`` holds one row per key)."""
    extra = [c for c in stored.columns if c not in (*key, size, mtime)]
    looked = lookup(current, stored.select(*key, size, mtime, *extra), key, size, mtime)
    return looked.where(F.col("status") == "hit").select(
        *current.columns, *[F.col(f"stored_{c}").alias(c) for c in extra])


def merge_results(stored_hits: DataFrame, fresh: DataFrame, key: list[str],
                  order: list[str]) -> DataFrame:
    """Bag union of stored and fresh results (U1), one row per key."""
    return latest_per_key(stored_hits.unionByName(fresh, allowMissingColumns=True), key, order)


# -- signature table ---------------------------------------------------------

_KEYED_SCHEMA = ("file_uri string, size bigint, mtime timestamp, hash_hex string, bits array<bigint>, "
                 "n_bits int, written_at bigint")


def _signatures_path(store: str) -> str:
    return f"{store.rstrip('/')}/signatures"


def _stream_path(store: str) -> str:
    return f"{store.rstrip('/')}/signatures_stream"


def _keyed_path(store: str, algorithm: str, hash_size: int) -> str:
    return f"{store.rstrip('/')}/signatures_by_key/algorithm={algorithm}/hash_size={int(hash_size)}"


def key_buckets(spark: SparkSession, store: str, algorithm: str, hash_size: int) -> list[int]:
    """Numbers of buckets that a partition's rows by key are kept in: one, or
    two while a compaction changes it, or none."""
    from sightline.sources.files import folder_names

    names = folder_names(spark, _keyed_path(store, algorithm, hash_size))
    return sorted(int(n.removeprefix("buckets=")) for n in names if n.startswith("buckets="))


def _keyed_table(spark: SparkSession, store: str, algorithm: str, hash_size: int, buckets: int) -> str:
    """The session's name for the bucketed table of one partition.  What makes it
    a table is in its files' names; the catalog entry only says so, and is made
    again by each session that needs it."""
    import hashlib

    from sightline.sources.files import qualified_path

    path = qualified_path(spark, f"{_keyed_path(store, algorithm, hash_size)}/buckets={int(buckets)}")
    name = f"sightline_{hashlib.sha1(path.encode()).hexdigest()[:20]}"
    quoted = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_KEYED_SCHEMA}) USING parquet CLUSTERED BY (file_uri) "
              f"SORTED BY (file_uri) INTO {int(buckets)} BUCKETS LOCATION '{quoted}'")
    spark.catalog.refreshTable(name)  # others may have appended
    return name


def _stored_parts(spark: SparkSession, store: str, algorithm: str, hash_size: int) -> list[DataFrame]:
    """All stored rows of one partition, with their write times: by key, appended
    plainly, streamed (read through its commit log, so only committed
    micro-batches count)."""
    columns = [*SIGNATURE_COLUMNS, "written_at"]
    parts = [spark.table(_keyed_table(spark, store, algorithm, hash_size, n)).select(*columns)
             for n in key_buckets(spark, store, algorithm, hash_size)]
    for path in (_signatures_path(store), _stream_path(store)):
        try:
            raw = spark.read.parquet(path)
        except AnalysisException:
            continue
        part = raw.where((F.col("algorithm") == algorithm) & (F.col("hash_size") == hash_size))
        if part.inputFiles() if not parts else not part.isEmpty():
            parts.append(part.select(*columns))
    return parts


def stored_signatures(spark: SparkSession, store: str, algorithm: str, hash_size: int,
                      prefix: str | None = None) -> DataFrame | None:
    """``read_signatures`` with ``written_at``."""
    parts = _stored_parts(spark, store, algorithm, hash_size)
    if prefix:
        parts = [p.where(F.col("file_uri").startswith(prefix)) for p in parts]
    if not parts:
        return None
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return latest_per_key(rows, ["file_uri"], ["written_at"])


def read_signatures(spark: SparkSession, store: str, algorithm: str,
                    hash_size: int, prefix: str | None = None) -> DataFrame | None:
    """Newest stored row per file for one (algorithm, hash_size) (S4, P5);
    the predicate prunes partitions.  ``prefix`` keeps files under one folder:
    it reaches the Parquet reader as ``StringStartsWith``, and as store files
    are sorted by ``file_uri`` whole row groups outside the folder are
    skipped.  None when nothing is stored.  Rows kept by key come in their
    buckets: no shuffle finds the newest or joins them on ``file_uri``."""
    newest = stored_signatures(spark, store, algorithm, hash_size, prefix)
    return None if newest is None else newest.drop("written_at")


def _append(rows: DataFrame, store: str, algorithm: str, hash_size: int) -> None:
    """Rows with ``written_at`` into the plain part."""
    (rows.withColumn("algorithm", F.lit(algorithm))
        .withColumn("hash_size", F.lit(int(hash_size)))
        .sortWithinPartitions("file_uri")
        .write.mode("append").partitionBy("algorithm", "hash_size")
        .parquet(_signatures_path(store)))


def _append_by_key(rows: DataFrame, store: str, algorithm: str, hash_size: int, buckets: int) -> None:
    spark = rows.sparkSession
    name = _keyed_table(spark, store, algorithm, hash_size, buckets)
    (rows.select(*[c.split()[0] for c in _KEYED_SCHEMA.split(", ")])
        .write.format("parquet").mode("append").bucketBy(int(buckets), "file_uri").sortBy("file_uri").saveAsTable(name))


def save_signatures(signatures: DataFrame, store: str, algorithm: str, hash_size: int,
                    rows: int | None = None) -> None:
    """Append hashed rows (only successful ones: failures are retried next
    time) stamped with this write's time.  With ``rows`` known the write is
    narrowed to about one file per ``ROWS_PER_FILE`` rows (no shuffle), so
    small searches do not leave a file per input split."""
    stamp = int(time.time() * 1_000_000)
    if rows is not None:
        signatures = signatures.coalesce(max(1, -(-int(rows) // ROWS_PER_FILE)))
    stamped = (signatures.where(F.col("bits").isNotNull()).select(*SIGNATURE_COLUMNS)
               .withColumn("written_at", F.lit(stamp).cast("bigint")))
    buckets = key_buckets(signatures.sparkSession, store, algorithm, hash_size)
    if buckets:
        # one task for a bucket: a file each, however many tasks hashed
        _append_by_key(stamped if rows is not None else stamped.repartition(buckets[-1], "file_uri"),
                       store, algorithm, hash_size, buckets[-1])
    else:
        _append(stamped, store, algorithm, hash_size)


def _file_names(df: DataFrame) -> list[str]:
    """The files that a stored part has now, about ``ROWS_PER_FILE`` rows each."""
    return [r["f"] for r in df.select(F.input_file_name().alias("f")).distinct().collect()]


def compact_signatures(spark: SparkSession, store: str, algorithm: str, hash_size: int,
                       buckets: int | None = None) -> None:
    """Rewrite one partition as one row per file, each with its own write time, so
    a writer that began before and commits later still wins or loses by its time.
    The folded rows are appended, then the files that were there at the start
    are removed: rows that other writers append meanwhile stay, and a stop in
    between leaves repeats that readers resolve.  With ``buckets`` (or where the
    partition has them already) the rows are kept by key.  Rows of a streamed part
    are folded too; its files belong to the stream's log and stay until
    ``fold_streamed``."""
    from sightline.session import fix
    from sightline.sources.files import remove_files, remove_folder

    # listed before the rows are read: a file in between is folded and stays
    old = key_buckets(spark, store, algorithm, hash_size)
    buckets = buckets or (old[-1] if old else None)
    old_files = [f for n in old for f in _file_names(spark.table(_keyed_table(spark, store, algorithm, hash_size, n)))]
    try:
        plain = spark.read.parquet(_signatures_path(store))
        old_files += _file_names(plain.where((F.col("algorithm") == algorithm) & (F.col("hash_size") == hash_size)))
    except AnalysisException:
        pass
    current = stored_signatures(spark, store, algorithm, hash_size)
    if current is None:
        return
    # sorted by file: prefix reads skip files and row groups by their min/max
    # statistics (by range here, within each bucket there)
    current = fix(current)
    if buckets:
        _append_by_key(current.repartition(buckets, "file_uri"), store, algorithm, hash_size, buckets)
    else:
        files = max(1, -(-current.count() // ROWS_PER_FILE))
        _append(current.repartitionByRange(files, "file_uri"), store, algorithm, hash_size)
    remove_files(spark, old_files)
    for n in old:
        if n != buckets:  # only files written meanwhile could be left there
            if spark.table(_keyed_table(spark, store, algorithm, hash_size, n)).isEmpty():
                remove_folder(spark, f"{_keyed_path(store, algorithm, hash_size)}/buckets={n}")


def fold_streamed(spark: SparkSession, store: str) -> None:
    """Move the rows of a streamed part into the table that everything else uses:
    they are appended with their own write times, then the streamed folder goes
    as a whole.  A stop in between leaves repeats that readers resolve; nothing
    may stream into that folder any more (this version's refreshes don't)."""
    from sightline.sources.files import remove_folder

    try:
        raw = spark.read.parquet(_stream_path(store))
    except AnalysisException:
        return
    for r in raw.select("algorithm", "hash_size").distinct().collect():  # one for each partition
        algorithm, hash_size = r["algorithm"], r["hash_size"]
        rows = raw.where((F.col("algorithm") == algorithm) & (F.col("hash_size") == hash_size))
        newest = latest_per_key(rows.select(*SIGNATURE_COLUMNS, "written_at"), ["file_uri"], ["written_at"])
        buckets = key_buckets(spark, store, algorithm, hash_size)
        if buckets:
            _append_by_key(newest.repartition(buckets[-1], "file_uri"), store, algorithm, hash_size, buckets[-1])
        else:
            _append(newest, store, algorithm, hash_size)
    remove_folder(spark, _stream_path(store))


# -- file inventory ----------------------------------------------------------

def inventory_meta(files: DataFrame, root_mtime: Column | None = None) -> DataFrame:
    """Per root: number of listed files (A4), their total size and the
    root's mtime — one aggregation."""
    meta = files.groupBy("root").agg(F.count(F.lit(1)).alias("file_count"),
                                     F.sum("size").alias("total_size"))
    mt = root_mtime if root_mtime is not None else F.lit(None).cast("timestamp")
    return meta.withColumn("root_mtime", mt).withColumn("scanned_at", F.current_timestamp())


def replace_inventory(files: DataFrame, store: str, root_mtime: Column | None = None,
                      roots: list[str] | None = None) -> None:
    """Replace the stored listing of every root present in ``files`` (S6):
    dynamic partition overwrite on ``root`` leaves other roots alone.  A root
    named in ``roots`` that has no files gets a meta row counting 0, so its
    old listing (which an overwrite without rows cannot remove) reads as
    stale."""
    base = store.rstrip("/")
    (files.select("root", "file_uri", "size", "mtime")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("root").parquet(f"{base}/inventory"))
    meta = inventory_meta(files, root_mtime)
    if roots:
        spark = files.sparkSession
        named = spark.createDataFrame([(r,) for r in roots], "root string")
        empty = (named.join(files.select("root").distinct(), "root", "left_anti")
                 .withColumn("file_count", F.lit(0).cast("bigint"))
                 .withColumn("total_size", F.lit(None).cast("bigint"))
                 .withColumn("root_mtime", (root_mtime if root_mtime is not None
                                            else F.lit(None)).cast("timestamp"))
                 .withColumn("scanned_at", F.current_timestamp()))
        meta = meta.unionByName(empty)
    (meta.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("root").parquet(f"{base}/inventory_meta"))


def freshness(stored_files: DataFrame, meta: DataFrame, current_roots: DataFrame) -> DataFrame:
    """Per root, whether the stored listing may be reused (S7): a meta row
    exists, the root's mtime is unchanged, and the stored row count equals
    the recorded count and is not zero.  ``current_roots`` holds ``root`` and
    ``root_mtime`` as seen now."""
    counts = stored_files.groupBy("root").agg(F.count(F.lit(1)).alias("stored_rows"))
    j = (current_roots.join(meta.select("root", F.col("root_mtime").alias("meta_mtime"),
                                        "file_count"), "root", "left")
         .join(counts, "root", "left"))
    fresh = (F.col("file_count").isNotNull()
             & F.col("root_mtime").eqNullSafe(F.col("meta_mtime"))
             & (F.coalesce(F.col("stored_rows"), F.lit(0)) > 0)
             & (F.col("stored_rows") == F.col("file_count")))
    return j.select("root", F.coalesce(F.col("stored_rows"), F.lit(0)).alias("stored_rows"),
                    "file_count", F.coalesce(fresh, F.lit(False)).alias("fresh"))


def read_inventory(spark: SparkSession, store: str, root: str,
                   root_mtime=None) -> DataFrame | None:
    """The stored listing of ``root`` when it is fresh, else None."""
    base = store.rstrip("/")
    try:
        files = spark.read.parquet(f"{base}/inventory").where(F.col("root") == root)
        meta = spark.read.parquet(f"{base}/inventory_meta").where(F.col("root") == root)
    except AnalysisException:
        return None
    now = spark.createDataFrame([(root, root_mtime)], "root string, root_mtime timestamp")
    verdict = freshness(files, meta, now).first()
    if verdict is None or not verdict["fresh"]:
        return None
    return files
