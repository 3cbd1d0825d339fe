"""Plan-shape checks: the physical plans keep the properties the scale design
relies on (see PLANS.md)."""

from pyspark.sql import functions as F

from sightline.operators import store
from sightline.operators.similarity import pair_search
from sightline.plans import catalog

SF = "/root/testdata/sf0.01"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_single_reference_search_is_a_narrow_filter(spark):
    plan = _plan(catalog.search_matches(spark, SF))
    assert "Exchange" not in plan and "Join" not in plan
    assert "bit_count" in plan
    assert "PushedFilters: [IsNotNull(vec_id), Not(EqualTo(vec_id,0))]" in plan
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


def test_small_reference_table_is_broadcast(spark):
    s = catalog.signatures(spark, SF, "average")
    refs = s.where(F.col("vec_id") < 5)
    plan = _plan(pair_search(refs, s, 64, 60.0, "vec_id", "vec_id"))
    assert "BroadcastNestedLoopJoin" in plan and "BroadcastExchange" in plan


def test_latest_per_key_aggregates_before_the_shuffle(spark):
    plan = _plan(catalog.q_signature_upsert(spark, SF))
    exchange = plan.index("Exchange hashpartitioning(user_id")
    assert "partial_max" in plan[exchange:]


def test_merge_results_unites_and_keeps_one_row_per_key(spark, monkeypatch):
    assert "Union" in _plan(catalog.q_merge_results(spark, SF))
    # a file listed twice, once as stored: one row, the stored one
    rows = spark.createDataFrame([(1, "a", 5, 7), (1, "a", 5, 8), (2, "b", 6, 7)], "user_id int, event_type string, size int, mtime int")
    monkeypatch.setattr(catalog, "_stored_and_current", lambda spark, d: (rows.where("user_id = 1 AND mtime = 7"), rows))
    got = sorted(tuple(r) for r in catalog.q_merge_results(spark, SF).collect())
    assert got == [(1, "a", 5, 7, "store"), (2, "b", 6, 7, "fresh")]


def test_store_read_pushes_prefix_and_prunes_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("file:/a/x.png", 1, None, "00", [1], 16)],
                                 "file_uri string, size long, mtime timestamp, hash_hex string, "
                                 "bits array<bigint>, n_bits int")
    store.save_signatures(rows, str(tmp_path), "average", 4)
    plan = _plan(store.read_signatures(spark, str(tmp_path), "average", 4, "file:/a/"))
    assert "StringStartsWith(file_uri,file:/a/)" in plan
    assert "(algorithm" in plan and "PartitionFilters" in plan


def test_picture_scan_filters_before_decoding(spark, tmp_path):
    from pngs import noise, write_png
    from sightline.sources.files import candidate_filter
    from sightline.sources.images import read_images, with_picture_signature

    write_png(tmp_path / "a.png", noise(1, 16))
    keep = candidate_filter(F.col("file_uri"), F.col("size"), "file:/nope.png", (10, 10_000))
    df = with_picture_signature(read_images(spark, str(tmp_path)).where(keep), "perceptual", 8)
    plan = _plan(df.hint("rebalance"))
    scan = plan[plan.index("FileScan image"):]
    assert "DataFilters" in scan and "file_size" in scan
    assert plan.count("ArrowEvalPython") == 1
    assert "REBALANCE" in plan
