"""The signature table kept by key, and the fold of a streamed part."""

import os

import pytest
from pyspark.sql import functions as F

from sightline.operators import store


def _rows(spark, ids, size, mtime="2024-01-01"):
    return spark.createDataFrame([(f"file:/r/{i}.png", size, f"{i:016x}", [i + size], 64) for i in ids],
                                 "file_uri string, size long, hash_hex string, bits array<bigint>, n_bits int").withColumn(
        "mtime", F.lit(mtime).cast("timestamp")).select(*store.SIGNATURE_COLUMNS)


def _read(spark, path):
    return {r["file_uri"]: r["size"] for r in store.read_signatures(spark, path, "average", 8).collect()}


def _exchanges_below_the_store(df):
    """Shuffles on the way from the stored files up to the join."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "FileScan parquet" in line and "Bucketed: true" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    out, d = [], depth(plan[at])
    for line in reversed(plan[:at]):
        if depth(line) < d:
            d = depth(line)
            if "Join" in line:
                break
            out += [line] if "Exchange" in line else []
    return out


def test_lookup_by_key_has_no_exchange_of_the_store(spark, tmp_path):
    path = str(tmp_path / "st'ore x")
    store.save_signatures(_rows(spark, range(40), 1), path, "average", 8)
    store.compact_signatures(spark, path, "average", 8, buckets=4)
    assert store.key_buckets(spark, path, "average", 8) == [4]
    store.save_signatures(_rows(spark, range(20, 60), 2), path, "average", 8)   # by key as well
    store.save_signatures(_rows(spark, range(5), 3), path, "average", 8, rows=5)
    assert _read(spark, path) == {f"file:/r/{i}.png": 3 if i < 5 else 1 if i < 20 else 2 for i in range(60)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        current = _rows(spark, range(10, 70), 2).select("file_uri", "size", "mtime")
        stored = store.read_signatures(spark, path, "average", 8, "file:/r/")
        for df in (store.lookup(current, stored, ["file_uri"]), store.misses(current, stored, ["file_uri"])):
            assert _exchanges_below_the_store(df) == []
        assert {r["file_uri"] for r in store.misses(current, stored, ["file_uri"]).collect()} == {
            f"file:/r/{i}.png" for i in [*range(10, 20), *range(60, 70)]}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # other sessions know nothing of the table but its folder
    other = spark.newSession()
    assert store.read_signatures(other, path, "average", 8).count() == 60


def test_compaction_changes_buckets_and_keeps_write_times(spark, tmp_path):
    path = str(tmp_path / "store")
    store.save_signatures(_rows(spark, range(10), 1), path, "average", 8)
    store.save_signatures(_rows(spark, range(10), 5), path, "difference", 7)
    times = lambda: sorted(map(tuple, store.stored_signatures(spark, path, "average", 8).select("file_uri", "written_at").collect()))
    first = times()
    for buckets in (None, 3, None, 5):
        store.compact_signatures(spark, path, "average", 8, buckets)
        assert times() == first and _read(spark, path) == {f"file:/r/{i}.png": 1 for i in range(10)}
    assert store.key_buckets(spark, path, "average", 8) == [5]
    assert store.read_signatures(spark, path, "difference", 7).count() == 10
    # a row stamped before the fold and committed after it loses to nothing newer, wins over older
    late = _rows(spark, [1], 9).withColumn("written_at", F.lit(first[0][1] + 1).cast("bigint"))
    store._append_by_key(late, path, "average", 8, 5)
    assert _read(spark, path)["file:/r/1.png"] == 9


def _streamed(spark, path, rows, tmp):
    """A streamed part as a file sink writes it."""
    rows.withColumn("written_at", F.lit(10 ** 15).cast("bigint")).write.parquet(f"{tmp}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp}/in").schema).parquet(f"{tmp}/in")
    query = (stream.withColumns({"algorithm": F.lit("average"), "hash_size": F.lit(8)}).writeStream.format("parquet")
             .option("checkpointLocation", f"{tmp}/ckpt").partitionBy("algorithm", "hash_size")
             .trigger(availableNow=True).start(f"{path}/signatures_stream"))
    query.awaitTermination()


@pytest.mark.parametrize("buckets", [None, 4])
def test_fold_streamed(spark, tmp_path, monkeypatch, buckets):
    from sightline.sources import files

    path = str(tmp_path / "store")
    _streamed(spark, path, _rows(spark, range(6), 1), tmp_path)
    store.save_signatures(_rows(spark, range(4, 8), 2), path, "average", 8)
    want = {f"file:/r/{i}.png": 1 if i < 4 else 2 for i in range(8)}
    assert _read(spark, path) == want
    if buckets:
        store.compact_signatures(spark, path, "average", 8, buckets)
        assert _read(spark, path) == want
    remove = files.remove_folder
    monkeypatch.setattr(files, "remove_folder", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):  # stopped between the two steps
        store.fold_streamed(spark, path)
    assert _read(spark, path) == want
    monkeypatch.setattr(files, "remove_folder", remove)
    store.fold_streamed(spark, path)
    assert _read(spark, path) == want and not os.path.exists(f"{path}/signatures_stream")
    store.fold_streamed(spark, path)  # nothing left to do
    store.compact_signatures(spark, path, "average", 8, buckets)
    assert len(store._stored_parts(spark, path, "average", 8)) == 1 and _read(spark, path) == want
