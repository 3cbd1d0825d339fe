"""``search``: pictures under a root similar to one reference picture (X2),
and ``batch_search`` for many references at once (J5).

Plan of ``search`` (steps 2-5 are ``folder_signatures``, which
``batch_search`` runs for both of its folders):

1. hash the reference (one row, fetched once; failure -> ValueError)
2. list the root by Spark tasks into a table (``sources.listing``; no path on
   the driver), drop the reference and files outside the size window
3. one left join against the newest stored rows splits the candidates into
   store hits (size and mtime unchanged) and misses
4. decode and hash the misses only, in slices of about ``slice_files``
   files whose paths are handed to the image reader; when the listing is a
   made now, all of it misses and the root's files fit one slice, a filtered
   scan of the root is decoded (the same files, without naming them)
5. checkpoint each slice's signatures (decoding runs once) and append the
   successful ones to the store, so a run that stops keeps finished slices
6. score everything against the reference as a literal, rank, count
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.bits import hamming_to_literal, max_distance
from sightline.functions.text import IMAGE_EXTENSIONS, is_image_path
from sightline.operators import store
from sightline.operators.hashes import validate_hash_size
from sightline.operators.ranking import number_rows
from sightline.operators.report import search_stats
from sightline.operators.similarity import (
    DEFAULT_MAX_BROADCAST_REFS,
    pair_search,
    score_against,
    size_bounds,
)
from sightline.session import ensure_checkpoint_dir, fix, scratch_path
from sightline.sources.files import (
    candidate_filter,
    folder_names,
    list_files,
    path_kind,
    path_mtime,
    qualified_uri,
    resolved,
)
from sightline.sources.images import picture_conf, read_images, with_picture_signature
from sightline.sources.listing import list_tree, supported


@dataclass
class SearchConfig:
    algorithm: str = "perceptual"
    hash_size: int = 16
    threshold: float = 90.0            # minimum similarity %, inclusive
    size_tolerance_pct: float | None = 50.0   # None: no size window
    reuse_signatures: bool = True      # read the store
    save_signatures: bool = True       # append fresh signatures to the store
    store_path: str | None = None      # None: no store at all
    reuse_inventory: bool = False      # take the listing from the store when fresh
    refresh_inventory: bool = False    # rewrite the stored listing
    extensions: tuple[str, ...] = field(default=IMAGE_EXTENSIONS)
    # files decoded and saved by one step; their paths pass the driver
    slice_files: int = 50_000
    max_broadcast_refs: int = DEFAULT_MAX_BROADCAST_REFS

    def __post_init__(self):
        validate_hash_size(self.algorithm, self.hash_size)

    @property
    def n_bits(self) -> int:
        return self.hash_size * self.hash_size

    @classmethod
    def preset(cls, name: str, **overrides) -> "SearchConfig":
        """The three option bundles of the command-line tool:
        'no-shortcuts' (no store read, still saves, relists, no size window),
        'thorough' (store and listing reuse, no size window), 'medium'
        (store and listing reuse, 50 % size window)."""
        bundles = {
            "no-shortcuts": dict(reuse_signatures=False, save_signatures=True,
                                 reuse_inventory=False, refresh_inventory=True,
                                 size_tolerance_pct=None),
            "thorough": dict(reuse_signatures=True, save_signatures=True,
                             reuse_inventory=True, size_tolerance_pct=None),
            "medium": dict(reuse_signatures=True, save_signatures=True,
                           reuse_inventory=True, size_tolerance_pct=50.0),
        }
        if name not in bundles:
            raise ValueError(f"unknown preset {name!r}; choose one of {sorted(bundles)}")
        return cls(**{**bundles[name], **overrides})


def _local_path(uri: str) -> str:
    """URI text from ``_metadata.file_path`` -> a path the readers accept."""
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return unquote(u.path)
    return uri


def _signatures_of(images: DataFrame, cfg: SearchConfig) -> DataFrame:
    return with_picture_signature(images, cfg.algorithm, cfg.hash_size)


def picture_signatures(spark: SparkSession, paths: str | list[str], algorithm: str = "perceptual",
                       hash_size: int = 16) -> DataFrame:
    """``file_uri, size, mtime, bits, hash_hex, n_bits, algorithm,
    hash_size`` for the pictures at ``paths`` (a folder, searched
    recursively, or a list of files); undecodable files get NULL bits (H6)."""
    cfg = SearchConfig(algorithm=algorithm, hash_size=hash_size)
    recursive = isinstance(paths, str) and path_kind(spark, paths) == "dir"
    return _signatures_of(read_images(spark, paths, recursive=recursive), cfg)


def reference_signature(spark: SparkSession, reference: str, cfg: SearchConfig):
    """(uri, size, words) of the reference picture; ValueError if it cannot
    be decoded."""
    pics = read_images(spark, reference, recursive=False, extensions=None)
    with picture_conf(spark):
        row = _signatures_of(pics, cfg).select("file_uri", "size", "bits").first()
    if row is None or row["bits"] is None or row["file_uri"] != qualified_uri(spark, reference):
        raise ValueError(f"could not process reference image: {reference}")
    return row["file_uri"], row["size"], list(row["bits"])


@dataclass
class _Listed:
    files: DataFrame          # file_uri, size, mtime of the wanted files
    scanned: bool             # listed now and small enough for a scan of the whole root
    skipped: int | None       # wanted files that Spark's readers can't open; None: not known


def _listing(spark: SparkSession, root: str, cfg: SearchConfig) -> _Listed:
    """The root's picture files.  The stored listing when it is fresh (same root
    mtime, same row count): it holds the files of all extensions, so it serves
    whatever extensions are asked.  Else a listing made now by Spark tasks
    (``sources.listing``), stored when asked; only a file system that tasks can't
    list goes through a reader's file index.  Hits don't matter: a fresh stored
    listing serves cold and warm searches alike, without listing the root again."""
    root_mtime = path_mtime(spark, root)
    wanted = is_image_path(F.col("file_uri"), cfg.extensions)
    if cfg.store_path and cfg.reuse_inventory and not cfg.refresh_inventory:
        stored = store.read_inventory(spark, cfg.store_path, root, root_mtime)
        if stored is not None:
            return _Listed(stored.where(wanted).select("file_uri", "size", "mtime"), False, None)
    skipped, total = None, 0
    if supported(qualified_uri(spark, root)):
        listing = list_tree(spark, root)
        skipped = listing.files.where(listing.skipped(cfg.extensions)).count() if listing.n_hidden else 0
        everything, total = listing.visible(None), listing.n_files
    else:
        everything = list_files(spark, root, None)
    if cfg.store_path and cfg.save_signatures and (cfg.reuse_inventory or cfg.refresh_inventory):
        store.replace_inventory(everything.withColumn("root", F.lit(root)), cfg.store_path,
                                F.lit(root_mtime).cast("timestamp"), roots=[root])
    return _Listed(everything.where(wanted), total <= cfg.slice_files, skipped)


def _undecoded(files: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Files as signature rows without a signature."""
    return files.select("file_uri", "size", "mtime", F.lit(None).cast("array<bigint>").alias("bits"),
                        F.lit(None).cast("string").alias("hash_hex"), F.lit(cfg.n_bits).alias("n_bits"))


def _decode_listed(spark: SparkSession, files: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Signatures of the listed files, read by path.  One row per listed file:
    a file that is gone has NULL bits, like one that can't be decoded, and the
    join on the URI lets no other file in."""
    listed = files.select("file_uri", "size", "mtime")
    paths = [_local_path(r["file_uri"]) for r in listed.select("file_uri").collect()]
    try:
        pics = read_images(spark, paths, recursive=False, extensions=None)
    except FileNotFoundError:
        paths = [p for p in paths if path_kind(spark, p) == "file"]
        pics = read_images(spark, paths, recursive=False, extensions=None) if paths else None
    if pics is None:
        return _undecoded(listed, cfg)
    # no repartition before the hash: it would shuffle decoded pixels; decode
    # work is spread by the scan's file splits
    sig = _signatures_of(pics, cfg).select(
        "file_uri", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), "bits", "hash_hex")
    return listed.join(sig, "file_uri", "left").select(
        "file_uri", F.coalesce("_size", "size").alias("size"), F.coalesce("_mtime", "mtime").alias("mtime"),
        "bits", "hash_hex", F.lit(cfg.n_bits).alias("n_bits"))


def _computed(spark: SparkSession, fresh: DataFrame) -> DataFrame:
    """Signature rows, decoded once.  Rebalance: the shuffle carries only
    signature rows (the pixels stay in the map tasks) and AQE sizes the
    partitions, so the checkpoint and the store get a few large files, not one
    per input split."""
    with picture_conf(spark):
        return fix(fresh.select("file_uri", "size", "mtime", "bits", "hash_hex", "n_bits").hint("rebalance"))


def listed_signatures(spark: SparkSession, files: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Signatures of a listing's files (file_uri, size, mtime; a slice: its paths
    pass the driver), computed once; NULL bits where a file can't be decoded."""
    return _computed(spark, _decode_listed(spark, files, cfg))


def folder_signatures(spark: SparkSession, root: str, cfg: SearchConfig,
                      keep: Column | None = None) -> tuple[DataFrame, int, int | None]:
    """``file_uri, size, mtime, bits`` for every picture file under ``root``
    that passes ``keep`` (bits NULL when it cannot be decoded), how many
    came from the store, and how many Spark's readers can't open by their names.  Stored signatures are reused while size and mtime
    are unchanged; only the rest is decoded, and successful new signatures
    are appended to the store."""
    keep = keep if keep is not None else F.lit(True)
    listed = _listing(spark, root, cfg)
    candidates = listed.files.where(keep)
    stored = None
    if cfg.store_path and cfg.reuse_signatures:
        prefix = qualified_uri(spark, root).rstrip("/") + "/"
        stored = store.read_signatures(spark, cfg.store_path, cfg.algorithm, cfg.hash_size, prefix)
    if stored is not None:
        # one join against the store, fixed once; hits and misses read it
        looked = fix(store.lookup(candidates, stored.select("file_uri", "size", "mtime", "bits"),
                                  ["file_uri"]))
        from_store = looked.where(F.col("status") == "hit").select(
            "file_uri", "size", "mtime", F.col("stored_bits").alias("bits"))
        to_hash = looked.where(F.col("status") != "hit").select("file_uri", "size", "mtime")
        tally = looked.agg(F.count_if(F.col("status") == "hit").alias("hits"),
                           F.count_if(F.col("status") != "hit").alias("misses")).first()
        n_hits, n_misses = tally["hits"], tally["misses"]
    else:
        from_store, to_hash, n_hits, n_misses = None, candidates, 0, candidates.count()

    parts = [] if from_store is None else [from_store]
    if n_misses > cfg.slice_files:
        parts.append(_hash_in_slices(spark, to_hash, -(-n_misses // cfg.slice_files), cfg))
    elif n_misses:
        if n_hits == 0 and listed.scanned:
            # the same files, without naming them; the image source passes over
            # empty ones, which can't be decoded anyway
            fresh = _signatures_of(read_images(spark, root, extensions=cfg.extensions).where(keep), cfg).select(
                "file_uri", "size", "mtime", "bits", "hash_hex", "n_bits").unionByName(
                _undecoded(to_hash.where(F.col("size") == 0), cfg))
        else:
            fresh = _decode_listed(spark, to_hash, cfg)
        fresh = _computed(spark, fresh)
        if cfg.store_path and cfg.save_signatures:
            store.save_signatures(fresh, cfg.store_path, cfg.algorithm, cfg.hash_size)
        parts.append(fresh.select("file_uri", "size", "mtime", "bits"))
    if not parts:
        return spark.createDataFrame(
            [], "file_uri string, size bigint, mtime timestamp, bits array<bigint>"), 0, listed.skipped
    results = parts[0]
    for p in parts[1:]:
        results = results.unionByName(p)
    return results, int(n_hits), listed.skipped


def _hash_in_slices(spark: SparkSession, to_hash: DataFrame, slices: int, cfg: SearchConfig) -> DataFrame:
    """Signatures of many files, one slice after another (only a slice's paths pass
    the driver).  The slices are the partitions of a table that one job writes,
    and their signatures those of another, so each slice reads its own rows only
    and the result is one scan, however many slices there were."""
    base = scratch_path(spark, f"slices-{uuid.uuid4().hex}")
    (to_hash.withColumn("slice", F.pmod(F.xxhash64("file_uri"), F.lit(slices)))
        .repartition("slice").write.partitionBy("slice").parquet(f"{base}/todo"))
    for name in sorted(folder_names(spark, f"{base}/todo")):
        if not name.startswith("slice="):
            continue
        mine = spark.read.schema("file_uri string, size bigint, mtime timestamp").parquet(f"{base}/todo/{name}")
        with picture_conf(spark):
            _decode_listed(spark, mine, cfg).hint("rebalance").write.parquet(f"{base}/hashed/{name}")
        if cfg.store_path and cfg.save_signatures:  # a run that stops keeps its finished slices
            store.save_signatures(spark.read.parquet(f"{base}/hashed/{name}"), cfg.store_path, cfg.algorithm, cfg.hash_size)
    return spark.read.schema("file_uri string, size bigint, mtime timestamp, bits array<bigint>").parquet(f"{base}/hashed").select(
        "file_uri", "size", "mtime", "bits")


def search(spark: SparkSession, reference: str, root: str,
           config: SearchConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Matches ``reference, candidate, distance, similarity_pct, file_size,
    rank`` and one row of counters."""
    cfg = config or SearchConfig()
    t0 = time.monotonic()
    ensure_checkpoint_dir(spark)
    if path_kind(spark, reference) != "file":
        raise FileNotFoundError(f"reference image not found: {reference}")
    if path_kind(spark, root) != "dir":
        raise FileNotFoundError(f"search directory not found: {root}")
    reference, root = resolved(spark, reference), resolved(spark, root)

    ref_uri, ref_size, ref_bits = reference_signature(spark, reference, cfg)
    bounds = size_bounds(ref_size, cfg.size_tolerance_pct)
    keep = candidate_filter(F.col("file_uri"), F.col("size"), ref_uri, bounds)
    results, n_hits, skipped = folder_signatures(spark, root, cfg, keep)

    ok = F.col("bits").isNotNull()
    d_max = max_distance(cfg.threshold, cfg.n_bits)
    matched = F.coalesce(hamming_to_literal(F.col("bits"), ref_bits) <= d_max, F.lit(False))
    counts = search_stats(results, ok, matched, 0.0).first()

    scored = score_against(results, ref_bits, cfg.n_bits, cfg.threshold)
    matches = number_rows(
        scored.select(F.lit(ref_uri).alias("reference"), F.col("file_uri").alias("candidate"),
                      "distance", "similarity_pct", F.col("size").alias("file_size")),
        [F.col("similarity_pct").desc(), F.col("candidate").asc()],
        known_rows=counts["matches_found"])
    elapsed = time.monotonic() - t0
    stats = spark.createDataFrame(
        [(counts["total_files"], counts["images_scanned"], counts["images_failed"],
          counts["matches_found"], elapsed, float(round(counts["images_scanned"] / max(elapsed, 0.001))),
          n_hits, skipped)],
        "total_files bigint, images_scanned bigint, images_failed bigint, matches_found bigint, "
        "elapsed_seconds double, speed_img_s double, signatures_reused bigint, names_skipped bigint")
    return matches, stats


def batch_search(spark: SparkSession, references: str, root: str,
                 config: SearchConfig | None = None) -> DataFrame:
    """Every (reference, candidate) pair within the threshold, ranked per
    reference.  ``references`` and ``root`` are folders; both take their
    signatures from the store when it is configured.  Each reference keeps
    its own size window and never matches itself."""
    cfg = config or SearchConfig()
    ensure_checkpoint_dir(spark)
    for path in (references, root):
        if path_kind(spark, path) != "dir":
            raise FileNotFoundError(f"folder not found: {path}")
    references, root = resolved(spark, references), resolved(spark, root)
    refs, _, _ = folder_signatures(spark, references, cfg)
    cands, _, _ = folder_signatures(spark, root, cfg)
    pairs = pair_search(refs, cands, cfg.n_bits, cfg.threshold, "file_uri", "file_uri",
                        size="size", size_tolerance_pct=cfg.size_tolerance_pct,
                        max_broadcast_refs=cfg.max_broadcast_refs)
    return number_rows(pairs, [F.col("similarity_pct").desc(), F.col("candidate").asc()],
                       by=["reference"])
