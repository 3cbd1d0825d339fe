"""Incremental signature refresh with Structured Streaming.

``refresh`` decides by the store: the root is listed by Spark tasks, one join
with the newest stored rows leaves the files that are new or whose size or time
changed (J1, J2), and those are written as a few listing files.  A stream over the
listing files (``trigger(availableNow=True)``) hands ``foreachBatch`` one of them at
a time, whose pictures are decoded and appended to the store.  So what the engine
remembers is the store, not a log of every path ever seen: a file rewritten in
place is hashed again, a copied file with an old time is taken, and a refresh that
was stopped goes on with what the store lacks.  A micro-batch that runs twice
appends equal rows, of which readers keep one.

``start_watch`` repeats the refresh at an interval.  ``start_refresh`` appends any
stream of signatures to the same table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from sightline.operators import store
from sightline.operators.hashes import with_signature
from sightline.session import fix, scratch_path
from sightline.sources import standins as st
from sightline.sources.files import list_files, qualified_uri, remove_folder, resolved
from sightline.sources.listing import forget, list_tree, supported


LISTED = "file_uri string, size bigint, mtime timestamp"


def start_refresh(signature_stream: DataFrame, store_path: str, checkpoint: str,
                  available_now: bool = True, output_files: int = 8) -> StreamingQuery:
    """Append the stream's successful signatures (columns of
    ``store.SIGNATURE_COLUMNS`` plus ``algorithm`` and ``hash_size``) to the store's
    table, micro-batch by micro-batch.  A batch that runs twice appends equal
    rows, of which readers keep one."""
    def append(batch: DataFrame, batch_id: int) -> None:
        # computed once; one shuffle after hashing (signature rows only, never
        # pixels) so each micro-batch writes ``output_files`` files at most
        rows = fix(batch.where(F.col("bits").isNotNull()).select(
            *store.SIGNATURE_COLUMNS, "algorithm", "hash_size").repartition(output_files))
        for r in rows.select("algorithm", "hash_size").distinct().collect():  # what the stream hashes with
            mine = rows.where((F.col("algorithm") == r["algorithm"]) & (F.col("hash_size") == r["hash_size"]))
            store.save_signatures(mine, store_path, r["algorithm"], r["hash_size"])

    writer = signature_stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def image_signature_stream(spark: SparkSession, root: str, algorithm: str, hash_size: int,
                           files_per_batch: int = 10_000) -> DataFrame:
    """Stream of signatures for pictures appearing under ``root``."""
    from sightline.sources.images import image_stream, with_picture_signature
    return with_picture_signature(image_stream(spark, root, files_per_batch), algorithm, hash_size)


def pending_files(spark: SparkSession, root: str, store_path: str, algorithm: str, hash_size: int,
                  files_per_batch: int) -> tuple[str, int]:
    """The listing minus the store: a folder of Parquet files of about
    ``files_per_batch`` rows (file_uri, size, mtime) still to be hashed, and how
    many rows they have.  No path passes the driver."""
    root = resolved(spark, root)
    if supported(qualified_uri(spark, root)):
        listing = list_tree(spark, root)
        files = listing.visible()
    else:
        listing, files = None, list_files(spark, root)
    stored = store.read_signatures(spark, store_path, algorithm, hash_size,
                                   qualified_uri(spark, root).rstrip("/") + "/")
    todo = files if stored is None else store.misses(files, stored.select("file_uri", "size", "mtime"), ["file_uri"])
    run = scratch_path(spark, f"refresh-{uuid.uuid4().hex}")
    todo.write.parquet(f"{run}/todo")
    if listing:
        forget(spark, listing)
    todo = spark.read.schema(LISTED).parquet(f"{run}/todo")
    n = todo.count()
    # numbered files of one size: a hash would make some batches larger
    batches = max(1, -(-n // files_per_batch))
    todo.repartition(batches).write.parquet(f"{run}/pending")
    return run, n


def refresh(spark: SparkSession, root: str, store_path: str, algorithm: str = "perceptual",
            hash_size: int = 16, files_per_batch: int = 10_000) -> int:
    """Hash the pictures under ``root`` that the store lacks, or has with another
    size or time, and stop; returns how many signatures were stored (undecodable
    files are read but not stored, and tried again by the next refresh)."""
    from sightline.plans.search import SearchConfig, listed_signatures

    cfg = SearchConfig(algorithm=algorithm, hash_size=hash_size)
    run, n = pending_files(spark, root, store_path, algorithm, hash_size, files_per_batch)
    gained: dict[int, int] = {}

    def hash_batch(listed: DataFrame, batch_id: int) -> None:
        fresh = listed_signatures(listed.sparkSession, listed, cfg)
        store.save_signatures(fresh, store_path, algorithm, hash_size)
        gained[batch_id] = fresh.where(F.col("bits").isNotNull()).count()

    if n:
        stream = (spark.readStream.schema(LISTED).option("maxFilesPerTrigger", 1).parquet(f"{run}/pending")
                  .writeStream.foreachBatch(hash_batch).option("checkpointLocation", f"{run}/checkpoint")
                  .trigger(availableNow=True).start())
        stream.awaitTermination()
    remove_folder(spark, run)
    return sum(gained.values())


def start_watch(spark: SparkSession, root: str, store_path: str, algorithm: str = "perceptual",
                hash_size: int = 16, every: str = "10 minutes", files_per_batch: int = 10_000) -> StreamingQuery:
    """Refresh at an interval until the returned query is stopped; its own state
    is a clock."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (clock.writeStream.trigger(processingTime=every)
            .foreachBatch(lambda _, batch_id: refresh(spark, root, store_path, algorithm, hash_size, files_per_batch) and None)
            .option("checkpointLocation", scratch_path(spark, f"watch-{uuid.uuid4().hex}")).start())


def refresh_standin_signatures(spark: SparkSession, sf_dir: str,
                               algorithm: str = "average") -> DataFrame:
    """The refresh run over the embeddings table as a file stream (one
    micro-batch per file), then read back as the store sees it."""
    k = st.STANDIN_HASH_SIZE[algorithm]
    path = f"{sf_dir.rstrip('/')}/embeddings.parquet"
    schema = spark.read.parquet(path).schema
    # a glob names the one file: a stream's root must otherwise be a folder
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
           .parquet(f"{sf_dir.rstrip('/')}/embeddings.parq[u]et")
           .select(F.col("vec_id").cast("string").alias("file_uri"),
                   F.transform("embedding", lambda x: x.cast("double")).alias("grid"),
                   (F.size("embedding") * 4).cast("bigint").alias("size"),
                   F.lit(None).cast("timestamp").alias("mtime")))
    sig = with_signature(src, "grid", algorithm, k, st.GRID_SIDE, st.GRID_SIDE)
    run = scratch_path(spark, f"refresh-{uuid.uuid4().hex}")
    q = start_refresh(sig, run, f"{run}/_checkpoint")
    q.awaitTermination()
    stored = read_streamed(spark, run, algorithm, k)
    return stored.select(F.col("file_uri").cast("bigint").alias("vec_id"), "hash_hex")


def read_refreshed(spark: SparkSession, store_path: str, algorithm: str, hash_size: int) -> DataFrame:
    """The newest signature of each file, as the store sees it."""
    found = store.read_signatures(spark, store_path, algorithm, hash_size)
    if found is None:
        raise FileNotFoundError(store_path)
    return found


read_streamed = read_refreshed  # streams append to the same table
