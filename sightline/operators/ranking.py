"""Result numbering from 1 (O1, O2) without a single-partition window.

``row_number()`` over an un-partitioned window, or over one reference that
holds most matches, sorts everything in one task.  Here the rows are range
partitioned on the full ordering (so a hot group is split across tasks),
sorted inside each partition, checkpointed so that partition contents are
fixed, and numbered as ``rows in earlier partitions + position inside the
partition``.  Only one count per partition reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.session import ensure_checkpoint_dir, fix


# A result counted to at most this many rows may be numbered in one task
# (a sort of ~100 MB); anything larger, or not counted, is numbered spread out.
SINGLE_TASK_ROWS = 1_000_000


def number_rows(df: DataFrame, order: list[Column], by: list[str] | None = None,
                name: str = "rank", partitions: int | None = None,
                known_rows: int | None = None) -> DataFrame:
    """Add ``name``: 1-based position of each row in ``order`` (within each
    ``by`` group when given).  ``order`` must be a total order (end it with a
    unique key) for the numbering to be deterministic.  ``known_rows`` is a
    count the caller already has; at most ``SINGLE_TASK_ROWS`` lets a plain
    window do the numbering."""
    if known_rows is not None and known_rows <= SINGLE_TASK_ROWS:
        from pyspark.sql import Window
        w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("bigint"))
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    by = list(by or [])
    keys = [F.col(c).asc() for c in by] + list(order)
    # without an explicit count AQE sizes the range partitions to the data
    ranged = (df.repartitionByRange(partitions, *keys) if partitions
              else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    fixed = fix(ranged)

    pid = F.spark_partition_id()
    tagged = (fixed.withColumn("_pid", pid)
                   .withColumn("_pos", F.monotonically_increasing_id()
                               - F.shiftleft(pid.cast("bigint"), 33)))
    counts = {r["_pid"]: r["n"] for r in
              tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, running = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(running)
        running += counts.get(p, 0)
    if not offsets:
        return fixed.withColumn(name, F.lit(None).cast("bigint")).limit(0)
    # one small row for each partition, not one literal each in an expression
    before = spark.createDataFrame(list(enumerate(offsets)), "_pid int, _before bigint")
    numbered = (tagged.join(F.broadcast(before), "_pid")
                .withColumn("_gpos", F.col("_before") + F.col("_pos")).drop("_before"))
    if not by:
        return numbered.withColumn(name, F.col("_gpos") + 1).drop("_pid", "_pos", "_gpos")
    # Group starts, keyed by (partition, group): a hot group spans many
    # partitions, so the join below gives no task more than one partition.
    per_part = numbered.groupBy("_pid", *by).agg(F.min("_gpos").alias("_first"))
    starts = per_part.groupBy(*by).agg(F.min("_first").alias("_gstart"))
    keyed = per_part.join(starts, by).select("_pid", *by, "_gstart")
    return (numbered.join(keyed, ["_pid", *by])
                    .withColumn(name, F.col("_gpos") - F.col("_gstart") + 1)
                    .drop("_pid", "_pos", "_gpos", "_gstart"))
