"""End-to-end search on real picture files (the reference's scenarios plus
failures, names, size window, store reuse)."""

import os

import numpy as np
import pytest

from pngs import half_size, noise, smooth, write_png
from sightline.plans.search import SearchConfig, batch_search, search
from sightline.sources.images import luminance, resize_luminance


def _names(matches):
    return {os.path.basename(r["candidate"].replace("%20", " ")) for r in matches.collect()}


def test_finds_duplicate_not_other(spark, tmp_path):
    write_png(tmp_path / "ref.png", noise(42))
    write_png(tmp_path / "dup.png", noise(42))
    write_png(tmp_path / "other.png", noise(999))
    cfg = SearchConfig(algorithm="perceptual", threshold=90.0, size_tolerance_pct=None)
    matches, stats = search(spark, str(tmp_path / "ref.png"), str(tmp_path), cfg)
    names = _names(matches)
    assert "dup.png" in names and "other.png" not in names
    s = stats.first()
    assert s["matches_found"] == matches.count()
    assert s["total_files"] == 2


def test_no_matches(spark, tmp_path):
    write_png(tmp_path / "ref.png", noise(1))
    write_png(tmp_path / "other.png", noise(2))
    cfg = SearchConfig(threshold=99.0, size_tolerance_pct=None)
    matches, stats = search(spark, str(tmp_path / "ref.png"), str(tmp_path), cfg)
    assert matches.count() == 0
    assert stats.first()["matches_found"] == 0


def test_empty_directory(spark, tmp_path):
    write_png(tmp_path / "ref.png", noise(7))
    (tmp_path / "empty").mkdir()
    matches, stats = search(spark, str(tmp_path / "ref.png"), str(tmp_path / "empty"),
                            SearchConfig(size_tolerance_pct=None))
    assert matches.count() == 0
    assert stats.first()["total_files"] == 0


def test_failures_names_resize_and_store(spark, tmp_path):
    root = tmp_path / "my pics, 2024"
    (root / "sub dir").mkdir(parents=True)
    write_png(root / "ref.png", smooth())
    write_png(root / "sub dir" / "my copy.PNG", smooth())
    write_png(root / "small.png", half_size(smooth()))
    write_png(root / "noise.png", noise(3))
    (root / "bad.jpg").write_bytes(b"not a picture")
    (root / "notes.txt").write_text("not listed")
    store = str(tmp_path / "store")
    for alg in ("perceptual", "average", "difference", "wavelet"):
        cfg = SearchConfig(algorithm=alg, threshold=90.0, size_tolerance_pct=None, store_path=store)
        matches, stats = search(spark, str(root / "ref.png"), str(root), cfg)
        names = _names(matches)
        assert {"my copy.PNG", "small.png"} <= names, (alg, names)
        assert "noise.png" not in names
        s = stats.first()
        assert (s["total_files"], s["images_failed"], s["images_scanned"]) == (4, 1, 3)
        ranks = [r["rank"] for r in matches.orderBy("rank").collect()]
        assert ranks == list(range(1, len(ranks) + 1))
        # second run reads the store: same answer, failures retried
        assert stats.first()["signatures_reused"] == 0
        again, stats2 = search(spark, str(root / "ref.png"), str(root), cfg)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, matches.collect()))
        s2 = stats2.first()
        assert s2["images_failed"] == 1
        assert s2["signatures_reused"] == 3  # every decodable file came from the store


def test_size_window_and_missing_paths(spark, tmp_path):
    write_png(tmp_path / "ref.png", noise(5, 64))
    write_png(tmp_path / "same.png", noise(5, 64))
    write_png(tmp_path / "big.png", noise(5, 256))
    cfg = SearchConfig(threshold=50.0, size_tolerance_pct=50.0)
    matches, stats = search(spark, str(tmp_path / "ref.png"), str(tmp_path), cfg)
    assert _names(matches) == {"same.png"}
    assert stats.first()["total_files"] == 1
    with pytest.raises(FileNotFoundError):
        search(spark, str(tmp_path / "nope.png"), str(tmp_path), cfg)
    with pytest.raises(FileNotFoundError):
        search(spark, str(tmp_path / "ref.png"), str(tmp_path / "nope"), cfg)
    (tmp_path / "broken.png").write_bytes(b"\x89PNG broken")
    with pytest.raises(ValueError):
        search(spark, str(tmp_path / "broken.png"), str(tmp_path), cfg)


def test_batch_search_pairs(spark, tmp_path):
    refs, root = tmp_path / "refs", tmp_path / "root"
    refs.mkdir()
    root.mkdir()
    write_png(refs / "a.png", noise(11))
    write_png(refs / "b.png", smooth())
    write_png(root / "a_copy.png", noise(11))
    write_png(root / "b_copy.png", smooth())
    write_png(root / "c.png", noise(12))
    cfg = SearchConfig(size_tolerance_pct=None)
    pairs = batch_search(spark, str(refs), str(root), cfg).collect()
    got = {(os.path.basename(r["reference"]), os.path.basename(r["candidate"]), r["rank"]) for r in pairs}
    assert got == {("a.png", "a_copy.png", 1), ("b.png", "b_copy.png", 1)}
    chunked = batch_search(spark, str(refs), str(root),
                           SearchConfig(size_tolerance_pct=None, max_broadcast_refs=1)).collect()
    assert sorted(map(tuple, chunked)) == sorted(map(tuple, pairs))
    stored = SearchConfig(size_tolerance_pct=None, store_path=str(tmp_path / "store"))
    for _ in range(2):  # second run takes both folders' signatures from the store
        again = batch_search(spark, str(refs), str(root), stored).collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, pairs))


def test_luminance_and_resize_properties():
    gray = np.full((10, 12), 77, dtype=np.uint8)
    assert (resize_luminance(gray, 4, 5) == 77).all()
    bgr = np.zeros((2, 2, 3), dtype=np.uint8)
    bgr[..., 2] = 255  # pure red
    lum = luminance(2, 2, 3, bgr.tobytes())
    assert (lum == (255 * 19595 + 0x8000) >> 16).all()
    ramp = np.tile(np.arange(64, dtype=np.uint8) * 4, (8, 1))
    small = resize_luminance(ramp, 8, 16)
    assert (np.diff(small[0].astype(int)) >= 0).all()


def test_listing_reuse_and_staleness(spark, tmp_path):
    from sightline.operators import store as st

    root = tmp_path / "pics"
    root.mkdir()
    write_png(root / "ref.png", noise(21))
    write_png(root / "dup.png", noise(21))
    write_png(root / "x.png", noise(22))
    cfg = SearchConfig.preset("medium", store_path=str(tmp_path / "store"), size_tolerance_pct=None)
    m1, s1 = search(spark, str(root / "ref.png"), str(root), cfg)
    assert _names(m1) == {"dup.png"} and s1.first()["total_files"] == 2
    from sightline.sources.files import path_mtime
    listed = st.read_inventory(spark, cfg.store_path, str(root), path_mtime(spark, str(root)))
    assert listed is not None and listed.count() == 3
    # a new file changes the folder's mtime: the stored listing is stale
    write_png(root / "dup2.png", noise(21))
    os.utime(root, (1e9, 1e9))
    assert st.read_inventory(spark, cfg.store_path, str(root), path_mtime(spark, str(root))) is None
    m2, s2 = search(spark, str(root / "ref.png"), str(root), cfg)
    assert _names(m2) == {"dup.png", "dup2.png"} and s2.first()["total_files"] == 3


def test_gray_and_alpha_copies_hash_alike(spark, tmp_path):
    rgb = smooth()
    lum = ((rgb[..., 0].astype(int) * 19595 + rgb[..., 1].astype(int) * 38470
            + rgb[..., 2].astype(int) * 7471 + 0x8000) >> 16).astype(np.uint8)
    gray_rgb = np.repeat(lum[..., None], 3, axis=2)
    write_png(tmp_path / "ref.png", gray_rgb)
    write_png(tmp_path / "gray.png", lum)
    rgba = np.concatenate([rgb, np.full(rgb.shape[:2] + (1,), 90, np.uint8)], axis=2)
    write_png(tmp_path / "color.png", rgb)
    write_png(tmp_path / "alpha.png", rgba)
    cfg = SearchConfig(algorithm="average", threshold=100.0, size_tolerance_pct=None)
    m, _ = search(spark, str(tmp_path / "ref.png"), str(tmp_path), cfg)
    assert "gray.png" in _names(m)  # gray file == same gray as RGB
    m2, _ = search(spark, str(tmp_path / "color.png"), str(tmp_path), cfg)
    assert "alpha.png" in _names(m2)  # alpha is dropped, not blended


def test_rewritten_file_is_hashed_again(spark, tmp_path):
    root = tmp_path / "pics"
    root.mkdir()
    write_png(root / "ref.png", noise(31))
    write_png(root / "a.png", noise(31))
    write_png(root / "b.png", noise(32))
    cfg = SearchConfig(threshold=90.0, size_tolerance_pct=None, store_path=str(tmp_path / "store"))
    m1, s1 = search(spark, str(root / "ref.png"), str(root), cfg)
    assert _names(m1) == {"a.png"} and s1.first()["signatures_reused"] == 0
    # b.png becomes a copy of the reference (new size/mtime): stale in the store
    write_png(root / "b.png", noise(31))
    os.utime(root / "b.png", (2e9, 2e9))
    m2, s2 = search(spark, str(root / "ref.png"), str(root), cfg)
    assert _names(m2) == {"a.png", "b.png"}
    assert s2.first()["signatures_reused"] == 1


def test_dense_resample_equals_tap_sums(monkeypatch):
    import sightline.sources.images as im

    rng = np.random.default_rng(1)
    for h, w, oh, ow in [(37, 53, 5, 9), (128, 128, 64, 64), (300, 200, 17, 16),
                         (64, 64, 128, 128), (50, 70, 8, 9)]:
        img = rng.integers(0, 256, size=(h, w), dtype=np.uint8)
        dense = im.resize_luminance(img, oh, ow)
        monkeypatch.setattr(im, "_DENSE_MAX_OUT", 0)
        gathered = im.resize_luminance(img, oh, ow)
        monkeypatch.setattr(im, "_DENSE_MAX_OUT", 256)
        assert (dense == gathered).all(), (h, w, oh, ow)


def test_list_files(spark, tmp_path):
    from sightline.sources.files import list_files

    (tmp_path / "sub").mkdir()
    write_png(tmp_path / "a.png", noise(1, 16))
    write_png(tmp_path / "sub" / "B.JPG", noise(2, 16))
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / ".hidden.png").write_bytes(b"x")
    (tmp_path / "noext").write_bytes(b"x")
    rows = {os.path.basename(r["file_uri"]): r["size"] for r in list_files(spark, str(tmp_path)).collect()}
    assert rows == {"a.png": (tmp_path / "a.png").stat().st_size,
                    "B.JPG": (tmp_path / "sub" / "B.JPG").stat().st_size}
    with pytest.raises(FileNotFoundError):
        list_files(spark, str(tmp_path / "missing"))


def test_picture_signatures(spark, tmp_path):
    from sightline import picture_signatures

    write_png(tmp_path / "a.png", noise(5, 32))
    write_png(tmp_path / "b.png", noise(5, 32))
    (tmp_path / "c.png").write_bytes(b"broken")
    rows = {os.path.basename(r["file_uri"]): r for r in
            picture_signatures(spark, str(tmp_path), "difference", 8).collect()}
    assert rows["a.png"]["hash_hex"] == rows["b.png"]["hash_hex"]
    assert len(rows["a.png"]["hash_hex"]) == 16 and rows["a.png"]["n_bits"] == 64
    assert rows["c.png"]["bits"] is None
    one = picture_signatures(spark, [str(tmp_path / "a.png")], "difference", 8).first()
    assert one["hash_hex"] == rows["a.png"]["hash_hex"]
