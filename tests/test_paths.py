"""Paths that readers could misread, links, and the listing rules."""

import os
import time

import pytest

from pngs import noise, write_png
from sightline.operators.report import json_document
from sightline.plans.search import SearchConfig, search


def _names(matches):
    return sorted(r["candidate"].rsplit("/", 1)[-1] for r in matches.collect())


@pytest.mark.parametrize("name", ["ref[1].png", "r{e,f}.png", "re*.png", "r?f.png", "back\\slash.png", "sp ace%20.png"])
def test_names_are_literal(spark, tmp_path, name):
    root = tmp_path / "a[1]"
    root.mkdir()
    write_png(root / name, noise(1, 32))
    for other in ("ref1.png", "re.png", "ref.png", "rf.png"):
        if not (root / other).exists():
            write_png(root / other, noise(2, 32))
    write_png(root / "dup[2].png", noise(1, 32))
    cfg = SearchConfig(size_tolerance_pct=None, store_path=str(tmp_path / "store"))
    matches, stats = search(spark, str(root / name), str(root), cfg)
    assert [m.replace("%5B", "[").replace("%5D", "]") for m in _names(matches)] == ["dup[2].png"]
    # warm, with a new file to read by its path
    write_png(root / "img[1].png", noise(1, 32))
    write_png(root / "img1.png", noise(3, 32))
    matches, stats = search(spark, str(root / name), str(root), cfg)
    s = stats.first()
    assert [m.replace("%5B", "[").replace("%5D", "]") for m in _names(matches)] == ["dup[2].png", "img[1].png"]
    assert s["total_files"] == len(list(root.iterdir())) - 1 and s["images_failed"] == 0


def test_slices_and_one_scan_agree(spark, tmp_path):
    root = tmp_path / "pics"
    root.mkdir()
    for i in range(9):
        write_png(root / f"p{i}.png", noise(i % 3, 32))
    (root / "bad.png").write_bytes(b"junk")
    found = []
    for n in (50_000, 2):
        cfg = SearchConfig(size_tolerance_pct=None, store_path=str(tmp_path / f"store{n}"), slice_files=n)
        matches, stats = search(spark, str(root / "p0.png"), str(root), cfg)
        s = stats.first()
        found.append((_names(matches), s["total_files"], s["images_scanned"], s["images_failed"]))
    assert found[0] == found[1] == (["p3.png", "p6.png"], 9, 8, 1)


def test_stored_listing_serves_cold_and_warm(spark, tmp_path):
    root = tmp_path / "pics"
    root.mkdir()
    write_png(root / "ref.png", noise(1, 32))
    write_png(root / "dup.png", noise(1, 32))
    (root / "sub").mkdir()
    write_png(root / "sub" / "x.png", noise(2, 32))
    store = str(tmp_path / "store")
    cfg = SearchConfig(size_tolerance_pct=None, store_path=store, reuse_inventory=True)
    assert search(spark, str(root / "ref.png"), str(root), cfg)[1].first()["total_files"] == 2
    write_png(root / "sub" / "y.png", noise(1, 32))  # the root's own mtime stays
    warm = search(spark, str(root / "ref.png"), str(root), cfg)[1].first()["total_files"]
    cold_cfg = SearchConfig(size_tolerance_pct=None, store_path=store, reuse_inventory=True, algorithm="average", hash_size=8)
    cold = search(spark, str(root / "ref.png"), str(root), cold_cfg)[1].first()["total_files"]
    assert warm == cold == 2
    os.remove(root / "sub" / "x.png")  # listed, gone: a failed file, not an error
    gone_cfg = SearchConfig(size_tolerance_pct=None, store_path=store, reuse_inventory=True, algorithm="difference", hash_size=8)
    s = search(spark, str(root / "ref.png"), str(root), gone_cfg)[1].first()
    assert (s["total_files"], s["images_failed"]) == (2, 1)


def test_links_resolve(spark, tmp_path):
    root = tmp_path / "real"
    root.mkdir()
    write_png(root / "ref.png", noise(1, 32))
    write_png(root / "other.png", noise(2, 32))
    (tmp_path / "link").symlink_to(root)
    (tmp_path / "ref-link.png").symlink_to(root / "ref.png")
    cfg = SearchConfig(size_tolerance_pct=None)
    for ref, where in ((root / "ref.png", tmp_path / "link"), (tmp_path / "ref-link.png", root)):
        assert _names(search(spark, str(ref), str(where), cfg)[0]) == []


def test_old_files_are_refreshed_and_counted(spark, tmp_path):
    from sightline.streaming.refresh import read_streamed, refresh

    root, store = tmp_path / "pics", str(tmp_path / "store")
    root.mkdir()
    for i in range(4):
        write_png(root / f"p{i}.png", noise(i, 32))
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", None)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        assert refresh(spark, str(root), store, "average", 8, files_per_batch=1) == 4
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
        else:
            spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    write_png(root / "old.png", noise(9, 32))
    month = time.time() - 30 * 86400
    os.utime(root / "old.png", (month, month))
    assert refresh(spark, str(root), store, "average", 8) == 1
    assert read_streamed(spark, store, "average", 8).count() == 5


def test_document_has_every_match(spark):
    ranked = spark.range(3).selectExpr("cast(id + 1 as int) as rank", "'r' as reference", "cast(id as string) as candidate",
                                       "100.0D as similarity_pct", "0 as distance", "1L as file_size")
    stats = spark.createDataFrame([(3, 3, 0, 3, 1.0)], "total_files bigint, images_scanned bigint, images_failed bigint, "
                                  "matches_found bigint, elapsed_seconds double")
    assert json_document(ranked, stats).count('"candidate"') == 3


def test_hash_once_per_row(spark):
    """At 256 bits the filter and the projection together hold one hash."""
    from pyspark.sql import functions as F
    from sightline.operators.hashes import with_signature
    from sightline.operators.similarity import score_against

    df = spark.range(4).select("id", F.transform(F.sequence(F.lit(1), F.lit(256)), lambda x: x.cast("double")).alias("g"))
    sig = with_signature(df, "g", "average", 16, 16, 16).select("id", "bits")
    plan = score_against(sig, [0, 0, 0, 0], 256, 50.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("aggregate(") <= 5 * 1  # the mean and four words, once


def test_slices_read_their_own_rows(spark, tmp_path):
    """The plan of the result doesn't grow with the slices, and a run that stops
    keeps the slices it finished."""
    from sightline.plans import search as m

    root = tmp_path / "pics"
    root.mkdir()
    for i in range(12):
        write_png(root / f"p{i}.png", noise(i, 32))
    leaves = []
    for n in (6, 1):
        cfg = SearchConfig(size_tolerance_pct=None, algorithm="average", hash_size=8, slice_files=n,
                           store_path=str(tmp_path / f"store{n}"))
        found, hits, _ = m.folder_signatures(spark, str(root), cfg)
        assert found.where("bits IS NOT NULL").count() == 12 and hits == 0
        leaves.append(found._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        assert m.folder_signatures(spark, str(root), cfg)[1] == 12
    assert leaves == [1, 1]
    decode, calls = m._decode_listed, []

    def stops(*args):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("stopped")
        return decode(*args)

    m._decode_listed = stops
    cfg = SearchConfig(size_tolerance_pct=None, algorithm="average", hash_size=8, slice_files=1, store_path=str(tmp_path / "stopped"))
    try:
        with pytest.raises(RuntimeError):
            m.folder_signatures(spark, str(root), cfg)
    finally:
        m._decode_listed = decode
    assert 0 < m.folder_signatures(spark, str(root), cfg)[1] < 12
