"""Session helpers: sane defaults for local runs, checkpoint directory."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every job here relies on.  AQE re-plans joins and coalesces
# partitions at run time; skew-join splitting covers hot join keys.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of plans that are gone are removed by the cleaner
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "sightline") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, taking it from the session.

    ``spark.checkpoint.dir`` is the cluster's shared folder.  Only a local
    session without that setting gets a scratch folder of its own; a cluster
    session without it is an error, as a machine-local folder would not
    survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        return spark.conf.get("spark.checkpoint.dir", "") or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; give the session a shared folder")
        configured = tempfile.mkdtemp(prefix="sightline-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder for tables a plan writes to cut lineage, under the shared
    checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/sightline/{name}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (pandas UDFs pickle
    its functions by reference): zip it once and ``addPyFile`` the archive,
    which Spark serves to every executor."""
    import os
    import zipfile

    try:
        sc = spark.sparkContext
        key = sc.applicationId
    except Exception:  # Spark Connect
        sc, key = None, f"connect-{id(spark)}"
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="sightline-code-"), "sightline.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    if sc is not None:
        sc.addPyFile(archive)
    else:
        spark.addArtifacts(archive, pyfile=True)
    _SHIPPED.add(key)


def fix(df):
    """Checkpoint ``df`` to the shared checkpoint folder, computing it once.

    A reliable checkpoint writes its files in a second job that would run
    the plan again; persisting first lets that job read the cached blocks.
    The cache is dropped once the files exist (lineage is cut, so a lost
    executor re-reads the files, not the plan)."""
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    level = df.storageLevel
    if level.useMemory or level.useDisk:  # the caller's cache: keep it
        return df.checkpoint(eager=True)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist()
