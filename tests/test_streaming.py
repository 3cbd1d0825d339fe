"""Incremental refresh (S9): new pictures are hashed once; a rerun on the same
checkpoint only picks up files it has not seen."""

from pyspark.sql import functions as F

from pngs import noise, write_png
from sightline.streaming.refresh import image_signature_stream, read_streamed, start_refresh


def _run(spark, root, store, ckpt):
    q = start_refresh(image_signature_stream(spark, str(root), "average", 8, files_per_batch=2),
                      str(store), str(ckpt))
    q.awaitTermination()
    return sum(p["numInputRows"] for p in q.recentProgress)


def test_refresh_resumes(spark, tmp_path):
    root, store, ckpt = tmp_path / "pics", tmp_path / "store", tmp_path / "ckpt"
    root.mkdir()
    for i in range(3):
        write_png(root / f"p{i}.png", noise(100 + i, 32))
    (root / "bad.png").write_bytes(b"junk")
    assert _run(spark, root, store, ckpt) == 4
    first = read_streamed(spark, str(store), "average", 8)
    assert first.count() == 3  # the undecodable file is not stored
    assert _run(spark, root, store, ckpt) == 0
    write_png(root / "p9.png", noise(109, 32))
    assert _run(spark, root, store, ckpt) == 1
    after = read_streamed(spark, str(store), "average", 8)
    assert after.count() == 4
    assert after.where(F.col("hash_hex").isNull()).count() == 0


def test_search_reuses_refreshed_signatures(spark, tmp_path):
    from sightline.plans.search import SearchConfig, search
    from sightline.streaming.refresh import refresh

    root, store = tmp_path / "pics", str(tmp_path / "store")
    root.mkdir()
    write_png(root / "ref.png", noise(61, 48))
    write_png(root / "dup.png", noise(61, 48))
    write_png(root / "other.png", noise(62, 48))
    assert refresh(spark, str(root), store, "perceptual", 16) == 3
    assert refresh(spark, str(root), store, "perceptual", 16) == 0
    cfg = SearchConfig(size_tolerance_pct=None, store_path=store)
    matches, stats = search(spark, str(root / "ref.png"), str(root), cfg)
    assert {r["candidate"].rsplit("/", 1)[-1] for r in matches.collect()} == {"dup.png"}
    assert stats.first()["signatures_reused"] == 2


def test_refresh_sees_new_subfolders(spark, tmp_path):
    from sightline.streaming.refresh import read_streamed, refresh

    root, store = tmp_path / "pics", str(tmp_path / "store")
    root.mkdir()
    write_png(root / "a.png", noise(71, 32))
    assert refresh(spark, str(root), store, "average", 8) == 1
    (root / "2025" / "june").mkdir(parents=True)
    write_png(root / "2025" / "june" / "b.png", noise(72, 32))
    assert refresh(spark, str(root), store, "average", 8) == 1
    assert read_streamed(spark, store, "average", 8).count() == 2


def test_refresh_by_the_store(spark, tmp_path):
    """Rewritten files are hashed again, old times are taken, hits are not read,
    and nothing of a refresh stays but the store."""
    import os

    from sightline.operators import store as tables
    from sightline.streaming.refresh import pending_files, read_refreshed, refresh

    root, store = tmp_path / "pics", str(tmp_path / "store")
    root.mkdir()
    for i in range(5):
        write_png(root / f"p{i}.png", noise(200 + i, 32))
    (root / "bad.png").write_bytes(b"junk")
    scratch = spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/sightline"
    before = set(os.listdir(scratch)) if os.path.isdir(scratch) else set()
    assert refresh(spark, str(root), store, "average", 8, files_per_batch=2) == 5
    first = {r["file_uri"]: r["hash_hex"] for r in read_refreshed(spark, store, "average", 8).collect()}
    write_png(root / "p1.png", noise(300, 32))           # rewritten in place
    write_png(root / "old.png", noise(301, 32))
    os.utime(root / "old.png", (1, 1))                   # copied with its old time
    os.remove(root / "p2.png")
    assert refresh(spark, str(root), store, "average", 8, files_per_batch=2) == 2
    after = {r["file_uri"]: r["hash_hex"] for r in read_refreshed(spark, store, "average", 8).collect()}
    assert {u.rsplit("/", 1)[1] for u in after if after[u] != first.get(u)} == {"p1.png", "old.png"}
    assert refresh(spark, str(root), store, "average", 8) == 0
    assert not {f for f in set(os.listdir(scratch)) - before if f.startswith(("refresh-", "listing-"))}
    run, n = pending_files(spark, str(root), store, "average", 8, 100)
    assert n == 1  # the undecodable one is tried again
    assert tables.read_signatures(spark, store, "average", 8).count() == 6


def test_refresh_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    import pytest
    from pyspark.errors import StreamingQueryException

    from sightline.operators import store as tables
    from sightline.streaming.refresh import read_refreshed, refresh

    root, store = tmp_path / "pics", str(tmp_path / "store")
    root.mkdir()
    for i in range(4):
        write_png(root / f"p{i}.png", noise(400 + i, 32))
    save, calls = tables.save_signatures, []

    def stops(*args, **kw):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return save(*args, **kw)

    monkeypatch.setattr(tables, "save_signatures", stops)
    with pytest.raises(StreamingQueryException):
        refresh(spark, str(root), store, "average", 8, files_per_batch=1)
    assert read_refreshed(spark, store, "average", 8).count() == 1
    monkeypatch.setattr(tables, "save_signatures", save)
    assert refresh(spark, str(root), store, "average", 8, files_per_batch=1) == 3


def test_watch(spark, tmp_path):
    import time

    from sightline.streaming.refresh import read_refreshed, start_watch

    root, store = tmp_path / "pics", str(tmp_path / "store")
    root.mkdir()
    write_png(root / "a.png", noise(500, 32))
    query = start_watch(spark, str(root), store, "average", 8, every="1 second")
    try:
        for n in (1, 2):
            for _ in range(120):
                try:
                    if read_refreshed(spark, store, "average", 8).count() == n:
                        break
                except FileNotFoundError:
                    pass
                time.sleep(0.5)
            else:
                raise AssertionError(f"{n} pictures not hashed; {query.exception()}")
            write_png(root / f"b{n}.png", noise(501, 32))
    finally:
        query.stop()
