"""The listing job against Spark's own listing and a directory walk."""

import os

import pytest

from sightline.functions.text import normalize_uri
from sightline.sources.files import list_files
from sightline.sources.listing import forget, hidden_name, list_tree


def _tree(root):
    """A deep and a wide branch, odd names, hidden names, links, empty folders."""
    made = []

    def put(path, size=3):
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * size)
        os.utime(p, ns=(10 ** 18 + 7 * 10 ** 6 * size, 10 ** 18 + 7 * 10 ** 6 * size + 123))
        made.append(p)

    put("/".join(f"d{i}" for i in range(8)).lstrip("/") + "/deep.png", 5)
    for i in range(60):
        put(f"wide/{i % 7}/{i}.jpg", i + 1)
    for name in ("sp ace%20.png", "a[1].png", "é#?.PNG", "q'\"x.png", "plus+&=.png", "semi;colon.webp", "no_extension", "x.txt"):
        put(f"odd names/{name}")
    for name in ("_DSC1.JPG", ".hid.png", "_k=v.png", "x.png._COPYING_", "_metadata.png"):
        put(name)
    put("_folder/in.png")
    put(".git/y.png")
    (root / "empty" / "inner").mkdir(parents=True)
    os.symlink(root / "x-target.png", root / "broken.png")
    return made


@pytest.mark.parametrize("budget", [1, 10, 20_000])
def test_equals_spark_listing(spark, tmp_path, budget):
    root = tmp_path / "tree"
    root.mkdir()
    made = _tree(root)
    listing = list_tree(spark, str(root), entries_per_folder=budget)
    for extensions in (None, (".png", ".jpg")):
        rows = lambda df: sorted((r["file_uri"], r["size"], r["mtime"]) for r in df.collect())
        assert rows(listing.visible(extensions)) == rows(list_files(spark, str(root), extensions))
    got = {r["file_uri"]: r["hidden"] for r in listing.files.collect()}
    assert set(got) == {normalize_uri(str(p)) for p in made}
    hidden = {normalize_uri(str(p)) for p in made if any(hidden_name(x) for x in p.relative_to(root).parts)}
    assert {u for u, h in got.items() if h} == hidden and len(hidden) == 6
    assert listing.unreadable == 0 and (listing.rounds > 2) == (budget < 20_000)
    assert listing.files.where(listing.skipped((".png",))).count() == 4
    forget(spark, listing)
    assert not os.path.exists(listing.path.removeprefix("file:"))


def test_links_unreadable_and_empty(spark, tmp_path):
    root = tmp_path / "t"
    (root / "sub").mkdir(parents=True)
    assert list_tree(spark, str(root)).files.count() == 0
    (root / "sub" / "a.png").write_bytes(b"a")
    os.symlink(root, root / "sub" / "loop")  # a folder that holds itself
    os.symlink(root / "sub" / "a.png", root / "b.png")
    bad = os.fsencode(str(root)) + b"/\xff.png"
    with open(bad, "wb") as f:
        f.write(b"x")
    listing = list_tree(spark, str(root), entries_per_folder=1)
    assert sorted(r["file_uri"].rsplit("/", 1)[1] for r in listing.files.collect()) == ["a.png", "b.png"]
    assert listing.unreadable == 1


def test_folder_that_goes_meanwhile(spark, tmp_path):
    from sightline.sources import listing as m

    root = tmp_path / "t"
    root.mkdir()
    rows = list(m._list_folders(normalize_uri(str(root)), 10)(iter([m.pd.DataFrame({"path": ["/gone", ""], "hidden": [False, False]})])))
    assert [r[0] for r in rows[0].itertuples(index=False)] == ["unreadable"]


def test_no_path_reaches_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    root = tmp_path / "t"
    root.mkdir()
    for i in range(30):
        (root / f"{i}").mkdir()
        (root / f"{i}" / "a.png").write_bytes(b"a")
    taken = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: taken.append(self.columns) or collect(self))
    listing = list_tree(spark, str(root), entries_per_folder=2)
    assert listing.rounds > 1 and not any("path" in c or "file_uri" in c for c in taken)


def test_stored_listing_serves_other_extensions(spark, tmp_path):
    """A listing stored by a search for one extension is complete for others."""
    from pngs import noise, write_png

    from sightline.plans.search import SearchConfig, search

    root, store = tmp_path / "pics", str(tmp_path / "store")
    root.mkdir()
    write_png(tmp_path / "ref.png", noise(1, 32))
    write_png(root / "a.png", noise(1, 32))
    write_png(root / "b.jpg", noise(1, 32))
    found = []
    for extensions in ((".png",), (".png", ".jpg"), (".jpg",)):
        cfg = SearchConfig(size_tolerance_pct=None, store_path=store, reuse_inventory=True, extensions=extensions)
        matches, _ = search(spark, str(tmp_path / "ref.png"), str(root), cfg)
        found.append(sorted(r["candidate"].rsplit("/", 1)[1] for r in matches.collect()))
    assert found == [["a.png"], ["a.png", "b.jpg"], ["b.jpg"]]


def test_search_counts_skipped_and_empty(spark, tmp_path):
    from pngs import noise, write_png

    from sightline.plans.search import SearchConfig, search

    root = tmp_path / "pics"
    root.mkdir()
    write_png(tmp_path / "ref.png", noise(1, 32))
    for name in ("a.png", "_DSC1.PNG", ".b.png", ".c.txt"):
        write_png(root / name, noise(1, 32))
    (root / "empty.png").write_bytes(b"")
    for slice_files in (50_000, 1):
        cfg = SearchConfig(size_tolerance_pct=None, slice_files=slice_files)
        s = search(spark, str(tmp_path / "ref.png"), str(root), cfg)[1].first()
        assert (s["names_skipped"], s["total_files"], s["images_failed"], s["matches_found"]) == (2, 2, 1, 1)
