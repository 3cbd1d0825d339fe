"""Substring dedup on words: de Bruijn compaction of repeated token k-mers.

Windows of ``window`` words are the edges of a de Bruijn graph.  Edges whose
anchor no other edge shares can't repeat and never enter it (``repeats``); runs
of edges with one anchor enter as one segment.  The repeated segments are then
compacted through joins: where every occurrence of a segment is followed by the
same next one, which in turn always follows it, the path doesn't branch and both
become one.  Each occurrence of a path keeps its source coordinates (row and
first word), from which the words to remove are read and checked against the
document's bounds.

Defined results: a null text has no words; texts of fewer words than a window
keep all; a repeated row is a document of its own, so its windows start
elsewhere; kept words are joined by one space; an empty table gives no row;
columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import discard, written
from sightline.llm.repeats import covered, mix, repeated_segments, window_ids, with_row_id

WINDOW = 35
GRAM = 12
BLOCK_IDS = 1_000_000
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def word_bytes(text: str | None) -> list[bytes]:
    """The pieces between ASCII white space (what bytes.split() cuts at)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def to_words(text: str | None) -> np.ndarray:
    words = word_bytes(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def first_ids(words: np.ndarray) -> dict[int, np.ndarray]:
    return {1: mix(words, words)}


def repeated_paths(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, first=first_ids) -> DataFrame:
    """(rid, lo, n, path): occurrences of the compacted paths of repeated
    windows, as ``n`` windows from word ``lo`` on; rows of ``with_row_id``."""
    found = repeated_segments(docs, window, gram, to_words, first, "words")
    edges = found.dropDuplicates(["rid", "lo"])
    along = Window.partitionBy("rid").orderBy("lo")
    # the neighbours on the path through a document; null at its ends
    linked = edges.select(
        "rid", "lo", "n", "eid",
        F.when(F.lead("lo").over(along) == F.col("lo") + F.col("n"), F.lead("eid").over(along)).alias("after"),
        F.when(F.lag(F.col("lo") + F.col("n")).over(along) == F.col("lo"), F.lag("eid").over(along)).alias("before"))
    one = lambda c: (F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c))
    # written before the join, so that Spark may split a hot edge's rows
    branching = written(linked.groupBy("eid").agg(one("after").alias("one_after"), one("before").alias("one_before")),
                        "words-branching")
    known = linked.join(branching, "eid")
    joins_on = F.col("one_before") & F.lag("one_after").over(along) & F.col("before").isNotNull()
    numbered = known.withColumn("cut", F.when(F.coalesce(joins_on, F.lit(False)), 0).otherwise(1)).withColumn(
        "part", F.sum("cut").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    paths = written(numbered.groupBy("rid", "part").agg(
        F.min("lo").alias("lo"), F.sum("n").cast("int").alias("n"),
        F.xxhash64(F.min_by("eid", "lo"), F.sum("n")).alias("path")).select("rid", "lo", "n", "path"), "words-paths")
    discard(found, branching)
    return paths


def _span_digest(words: list[bytes], lo: int, n: int, window: int) -> bytes:
    """A digest of the words that ``n`` windows from ``lo`` on cover: no word holds
    a space, so joined by one they are told apart."""
    return hashlib.blake2b(b" ".join(words[lo:lo + n + window - 1]), digest_size=16).digest()


def _halves(digest: bytes) -> tuple[int, int]:
    """A digest as two numbers: Spark aggregates these without sorting."""
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _with_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """``rows`` with ``places``: the (lo, n, path) of each row's paths."""
    per_row = paths.groupBy("rid").agg(F.collect_list(F.struct("lo", "n", "path")).alias("places"))
    return rows.join(per_row.hint("shuffle_hash"), "rid", "left").select("rid", "doc_id", "text", "places")


def _cut(marked: DataFrame, window: int, kept: bool) -> DataFrame:
    """The result rows, with ``rid`` and ``checks``: each removed path's source
    coordinates and the digest of the words there."""
    fields = SCHEMA.split(", ")[:5 if kept else 4]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = pa.list_(pa.struct([("path", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())]))
        kinds = [*([pa.int64()] * 3 + [pa.string()] * 2)[:len(fields)], pa.int64(), check]
        names = [*[f.split()[0] for f in fields], "rid", "checks"]
        for b in batches:
            out = []
            for rid, doc_id, text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                words = word_bytes(text.as_py())
                found, rest, checks = places.as_py(), words, []
                if found:
                    assert all(p["lo"] + p["n"] + window - 1 <= len(words) for p in found), "outside its source"
                    for p in found:
                        d1, d2 = _halves(_span_digest(words, p["lo"], p["n"], window))
                        checks.append({**p, "d1": d1, "d2": d2})
                    gone = covered(len(words), found, window)
                    rest = [w for w, g in zip(words, gone.tolist()) if not g]
                body = b" ".join(rest)
                row = (doc_id, len(words), len(words) - len(rest), hashlib.sha256(body).hexdigest(),
                       body.decode("utf-8", "replace"))
                out.append((*row[:len(fields)], rid, checks))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    kind = "rid long, checks array<struct<path:bigint,lo:int,n:int,d1:bigint,d2:bigint>>"
    return marked.mapInArrow(cut, f"{', '.join(fields)}, {kind}")


def _exact_windows(rows: DataFrame, runs: DataFrame, window: int, first) -> DataFrame:
    """(rid, lo, n = 1): windows with an identifier of one of ``runs`` that really
    start elsewhere, by digests of their words.  Identifiers go out in blocks of
    ``BLOCK_IDS``, each with a pass over all texts."""
    spark = rows.sparkSession
    per_row = runs.groupBy("rid").agg(F.collect_set(F.struct("lo", "n")).alias("places"))

    def identifiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, places in zip(b.column(0), b.column(1)):
                todo = [(p["lo"], p["n"]) for p in places.as_py()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.unique(np.concatenate(window_ids(to_words(text.as_py()), todo, window, first))))], names=["wid"])

    asked = written(rows.join(per_row, "rid").select("text", "places").mapInArrow(identifiers, "wid long").distinct(), "words-asked")
    blocks = max(1, -(-asked.count() // BLOCK_IDS))
    found = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("wid"), F.lit(blocks)) == block)
        wanted = spark.sparkContext.broadcast(np.sort(mine.toPandas()["wid"].to_numpy(np.int64)))

        def occurrences(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for rid, text in zip(b.column(0).to_pylist(), b.column(1)):
                    words, units = word_bytes(text.as_py()), to_words(text.as_py())
                    if len(words) < window:
                        continue
                    ids = window_ids(units, [(0, len(words) - window + 1)], window, first)[0]
                    at = np.flatnonzero(np.isin(ids, wanted.value)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_span_digest(words, i, 1, window) for i in at.tolist()], pa.binary()),
                         pa.array(np.full(len(at), rid, np.int64)), pa.array(at)], names=["digest", "rid", "lo"])

        part = written(rows.select("rid", "text").mapInArrow(occurrences, "digest binary, rid long, lo int"), "words-exact")
        found = part if found is None else found.unionByName(part)
    again = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    real = found.join(again, "digest").select("rid", "lo", F.lit(1).alias("n"), F.lit(0).cast("long").alias("path"))
    return written(real.distinct(), "words-verified")  # equal rows have found the same


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text_col: str = "text",
                          id_col: str = "doc_id", kept: bool = True, first=first_ids) -> DataFrame:
    """One row per document: word counts, the SHA-256 of the kept words joined
    by a space and (with ``kept``) that text.

    Every removed path that occurs more than once is compared with its other
    occurrences, by digests of the words at their source coordinates.  Where an
    occurrence has words that no other has (identifiers ``first`` collided), its
    windows are decided anew by their words."""
    rows = with_row_id(docs, text_col, id_col)
    paths = repeated_paths(rows, window, gram, first)
    done = written(_cut(_with_paths(rows, paths), window, kept), "words-done")
    checks = done.select("rid", F.explode("checks").alias("c")).select("rid", "c.*")
    # a path of one occurrence has its like inside longer paths; the others agree in
    # one digest unless identifiers collided
    torn = written(checks.groupBy("path").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("d1", "d2")])
                   .where("min_d1 <> max_d1 OR min_d2 <> max_d2").select("path"), "words-torn")
    if not torn.isEmpty():
        alone = written(checks.join(torn, "path").groupBy("path", "d1", "d2").agg(
            F.count(F.lit(1)).alias("times"), F.min(F.struct("rid", "lo", "n")).alias("at")).where("times = 1")
            .select("path", "at.*"), "words-alone")
        good = paths.join(alone.select("rid", "lo", "n", "path"), ["rid", "lo", "n", "path"], "left_anti")
        exact = _exact_windows(rows, alone, window, first)
        done = written(_cut(_with_paths(rows, good.unionByName(exact)), window, kept), "words-done")
    discard(paths, torn)
    return done.drop("rid", "checks")


def oracle_sql() -> str:
    """The registered query as DuckDB SQL over all windows."""
    return f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + {WINDOW - 1}], ' ')) AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM d WHERE len(w) >= {WINDOW})),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + {WINDOW})) AS p FROM again)),
words AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n
         FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p
         WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
