"""Ranking without single-partition windows; store operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.operators import store
from sightline.operators.ranking import number_rows
from sightline.operators.similarity import band_layout, pair_search
from sightline.functions.bits import pack_bits


def test_number_rows_matches_row_number_with_hot_group(spark):
    # one group holds most rows and many ties on the first key
    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("g"),
        (F.col("id") % 3).alias("score"), F.col("id").alias("key"))
    order = [F.col("score").desc(), F.col("key").asc()]
    got = number_rows(df, order, by=["g"], partitions=7).select("g", "key", "rank")
    w = Window.partitionBy("g").orderBy(*order)
    want = df.withColumn("rank", F.row_number().over(w)).select("g", "key", "rank")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    flat = number_rows(df, order, partitions=5)
    want2 = df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    assert flat.select("key", "rank").exceptAll(want2.select("key", "rank")).count() == 0
    assert number_rows(df.limit(0), order).count() == 0
    counted = number_rows(df, order, by=["g"], known_rows=5000).select("g", "key", "rank")
    assert counted.exceptAll(want).count() == 0 and want.exceptAll(counted).count() == 0


def test_banded_join_equals_nested_loop(spark):
    import random
    rng = random.Random(3)
    base = [[rng.random() < 0.5 for _ in range(64)] for _ in range(40)]
    rows = []
    for i in range(400):
        b = list(base[i % 40])
        for _ in range(rng.randint(0, 20)):
            j = rng.randrange(64)
            b[j] = not b[j]
        rows.append((i, b, 1000 + i))
    df = spark.createDataFrame(rows, "id long, f array<boolean>, size long") \
              .withColumn("bits", pack_bits(F.col("f"), 64)).drop("f")
    refs = df.where(F.col("id") < 60)
    a = pair_search(refs, df, 64, 75.0, "id", "id", size="size", size_tolerance_pct=10.0)
    assert a.count() > 0
    for strategy, hot in (("banded", 100_000), ("banded", 3), ("metric", 100_000), ("metric", 3), ("chunked", 100_000)):
        b = pair_search(refs, df, 64, 75.0, "id", "id", size="size", size_tolerance_pct=10.0,
                        max_broadcast_refs=25, strategy=strategy, hot_band_rows=hot)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, (strategy, hot)
    assert sum(n for _, n in band_layout(64, 16)) == 64


def test_upsert_lookup_misses(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("c", 3, 30)], "k string, size int, mtime int")
    new = spark.createDataFrame([("b", 5, 50), ("b", 6, 60), ("d", 4, 40)], "k string, size int, mtime int")
    up = {r["k"]: (r["size"], r["mtime"]) for r in store.upsert(old, new, ["k"], ["mtime"]).collect()}
    assert up == {"a": (1, 10), "b": (6, 60), "c": (3, 30), "d": (4, 40)}
    cur = spark.createDataFrame([("a", 1, 10), ("b", 2, 21), ("e", 9, 90)], "k string, size int, mtime int")
    st = {r["k"]: r["status"] for r in store.lookup(cur, old, ["k"]).collect()}
    assert st == {"a": "hit", "b": "stale", "e": "miss"}
    assert {r["k"] for r in store.misses(cur, old, ["k"]).collect()} == {"b", "e"}
    assert {r["k"] for r in store.hits(cur, old, ["k"]).collect()} == {"a"}


def test_inventory_replace_and_freshness(spark, tmp_path):
    path = str(tmp_path / "store")
    files = spark.createDataFrame(
        [("r1", "r1/a", 1, None), ("r1", "r1/b", 2, None), ("r2", "r2/c", 3, None)],
        "root string, file_uri string, size long, mtime timestamp")
    store.replace_inventory(files, path)
    assert store.read_inventory(spark, path, "r1").count() == 2
    assert store.read_inventory(spark, path, "r3") is None
    # replacing r1 leaves r2 alone
    store.replace_inventory(files.where(F.col("file_uri") == "r1/a"), path)
    assert store.read_inventory(spark, path, "r1").count() == 1
    assert store.read_inventory(spark, path, "r2").count() == 1
    # r2 emptied: its old rows cannot be overwritten away, the meta row says 0
    store.replace_inventory(files.where(F.col("root") == "r1"), path, roots=["r1", "r2"])
    assert store.read_inventory(spark, path, "r2") is None
    assert store.read_inventory(spark, path, "r1").count() == 2


def test_signature_save_read_compact(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame(
        [("f1", 1, None, "00ff", [255], 16), ("f2", 2, None, "0001", [1], 16)],
        "file_uri string, size long, mtime timestamp, hash_hex string, bits array<bigint>, n_bits int")
    store.save_signatures(rows, path, "average", 4)
    store.save_signatures(rows.where("file_uri = 'f1'").withColumn("hash_hex", F.lit("0f0f")), path, "average", 4)
    got = {r["file_uri"]: r["hash_hex"] for r in store.read_signatures(spark, path, "average", 4).collect()}
    assert got == {"f1": "0f0f", "f2": "0001"}
    assert store.read_signatures(spark, path, "perceptual", 16).count() == 0
    store.compact_signatures(spark, path, "average", 4)
    raw = spark.read.parquet(f"{path}/signatures").where("algorithm = 'average'")
    assert raw.count() == 2


def test_reports_and_presets(spark, tmp_path):
    import json

    from sightline.functions.text import normalize_uri
    from sightline.operators.report import json_document, write_json_report
    from sightline.plans.search import SearchConfig

    stats = spark.createDataFrame([(2847, 2843, 4, 3, 4.52)],
                                  "total_files long, images_scanned long, images_failed long, "
                                  "matches_found long, elapsed_seconds double")
    ranked = spark.createDataFrame(
        [("r", "c1", 0, 100.0, 2_411_724, 1), ("r", "c2", 9, 96.484375, 876_544, 2)],
        "reference string, candidate string, distance int, similarity_pct double, file_size long, rank long")
    doc = json.loads(json_document(ranked, stats))
    assert [m["candidate"] for m in doc["matches"]] == ["c1", "c2"]
    assert list(doc["matches"][0]) == ["reference", "candidate", "similarity_pct", "distance", "file_size"]
    assert doc["stats"]["matches_found"] == 3
    write_json_report(ranked, stats, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "matches")).count() == 2
    assert normalize_uri("/a/my pic.png") == "file:/a/my%20pic.png"
    assert SearchConfig.preset("thorough").size_tolerance_pct is None
    assert SearchConfig.preset("no-shortcuts").reuse_signatures is False
    assert SearchConfig.preset("medium", threshold=80).threshold == 80


def test_latest_per_key_with_hot_key(spark):
    # a third of all rows share one key
    df = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").alias("ver"), (F.col("id") * 7).alias("payload"))
    got = {r["k"]: (r["ver"], r["payload"]) for r in store.latest_per_key(df, ["k"], ["ver"]).collect()}
    assert got["hot"] == (29997, 29997 * 7)
    assert len(got) == 20001


def test_normalize_uri_matches_spark_spelling(spark, tmp_path):
    from sightline.functions.text import normalize_uri

    names = ["a b.png", "c,d.png", "e+f=g.png", "h%i.png", "j#k.png", "l@m;n.png",
             "\u00f6 \u00fc.png", "p(q)~r!.png", "s&t$u.png", "v'w*.png"]
    for n in names:
        (tmp_path / n).write_bytes(b"x")
    got = {r[0] for r in spark.read.format("binaryFile").load(str(tmp_path))
           .select(F.col("_metadata.file_path")).collect()}
    assert got == {normalize_uri(str(tmp_path / n)) for n in names}
