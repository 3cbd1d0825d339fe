"""Helpers shared by the corpus operators: table access, expression binding,
scratch tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.session import scratch_path, ship_package

# the word separator of the contracts that split at ASCII white space
SPACE_RE = r"[\x20\x09-\x0D]+"

_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Arrow batches to Python are cut by bytes: rows carry whole texts and sets.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """What operators with Python tasks need of a session: the package on the
    executors, and Arrow batches bounded by bytes unless the session says how."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


# What the last operator keeps between its tasks in this Python worker.
_kept: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], object] | None = None):
    """An object that a Python worker keeps between tasks of one operator.
    Workers are shared: a task of another operator drops what was kept, so
    memory doesn't add up over the stages of a pipeline.  Operators that keep
    nothing call it too, without ``make``."""
    if name not in _kept:
        _kept.clear()
        if make:
            _kept[name] = make()
    return _kept.get(name)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    The value becomes a lambda variable of a one-element array, so that
    Catalyst can't copy its expression into each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_all(values: list[Column], body: Callable[..., Column]) -> Column:
    """``let`` for several values of different types."""
    pack = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return let(pack, lambda s: body(*[s.getField(f"v{i}") for i in range(len(values))]))


def words_of(text: Column, separators: str = SPACE_RE) -> Column:
    """The non-empty pieces between separators; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(text, separators, -1), ""),
                      F.array().cast("array<string>"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back:
    lineage is cut, and a lost executor loses none of it.  The table is
    removed by ``discard`` or when the driver program ends."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove_written)
    _written[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._written_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove written tables that no later job reads, and let Spark's cleaner
    drop the shuffle files of jobs that have ended: it waits for the driver's
    garbage collection, which small plans alone may not cause for long."""
    for df in tables:
        _remove(df._written_path)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def _remove(path: str) -> None:
    sc = _written.pop(path).sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def _remove_written() -> None:
    for path in list(_written):
        try:
            _remove(path)
        except Exception:  # the session has ended: its folder stays
            return


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod ``folds``: the contracts' hold-out split.
    A null id counts as the empty text."""
    return (F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds).cast("int")
