"""Windows of consecutive units (bytes or words) that start more than once in a
corpus, found exactly from a sample of anchors.

Identifiers.  Every position gets the identifier of the units that follow it:
identifiers of ``2h`` units come from the two identifiers of ``h`` units at the
position and ``h`` later, and so on up to the whole window.  They are 64-bit
digests of the content, hence the same in every task.

Anchors.  Of the ``gram``-identifiers inside a window the smallest is the
window's anchor (the leftmost of equals).  Equal windows have their anchor at
the same offset, so windows can be equal only if their anchors are.  Runs of
windows with one anchor are *segments*; a corpus has about one segment for
each ``(window - gram + 2) / 2`` units.

Buckets.  Spark counts anchors by identifier: a segment whose bucket has one
row can't repeat.  In the others, segments of equal content repeat as a whole;
where a bucket holds different segments, its distinct segments are refined to
single windows, whose identifiers are counted.  All counts are partial
aggregates before a shuffle, and the joins back are sort-merge joins that may
be split, so a passage that a third of all rows share meets no single task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import discard, prepare, written

SLAB_UNITS = 1 << 20
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_POSITION = np.uint64((1 << 24) - 1)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit digest of two identifiers, in this order."""
    x = b >> np.uint64(31)
    x ^= a
    x *= _K1
    x += b * _K2
    x ^= x >> np.uint64(29)
    x *= _K3
    x ^= x >> np.uint64(32)
    return x


def widen(ids: dict[int, np.ndarray], size: int) -> np.ndarray:
    """Identifiers of ``size`` units from the two of the widest known size that
    cover them: the first at the position, the second at a later offset."""
    have = max(k for k in ids if k <= size)
    while have < size:
        wide = min(2 * have, size)
        base = ids[have]
        ids[wide] = mix(base[:len(base) - (wide - have)], base[wide - have:])
        have = wide
    return ids[size]


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each ``span`` consecutive values, by blocks: the end of
    one block and the start of the next cover every window."""
    n = len(x) - span + 1
    blocks = -(-len(x) // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    grid = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    back = np.minimum.accumulate(grid, axis=1).ravel()
    return np.minimum(ahead[:n], back[span - 1:span - 1 + n])


def slabs(units: list[np.ndarray], window: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Lists of (document, first position, units) of about ``SLAB_UNITS``
    together; a longer document comes in pieces that overlap by a window."""
    out, size = [], 0
    for d, u in enumerate(units):
        for s in range(0, max(len(u) - window + 1, 0), SLAB_UNITS):
            piece = u[s:s + SLAB_UNITS + window - 1]
            out.append((d, s, piece))
            size += len(piece)
            if size >= SLAB_UNITS:
                yield out
                out, size = [], 0
    if out:
        yield out


def segments(units: list[np.ndarray], window: int, gram: int,
             first: Callable[[np.ndarray], dict[int, np.ndarray]]) -> Iterator[tuple]:
    """(document, anchor id, content id, first window, windows) arrays of all
    segments.  ``first`` gives the identifiers to start from."""
    span = window - gram + 1
    for slab in slabs(units, window):
        joined = np.concatenate([u for _, _, u in slab])
        ids = first(joined)
        grams = widen(ids, gram)
        whole = widen(ids, window)
        key = ((grams * _K2) & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        anchor = (sliding_min(key, span) & _POSITION).astype(np.int64)
        ends = np.cumsum([len(u) for _, _, u in slab])
        begins = ends - [len(u) for _, _, u in slab]
        inside = np.ones(len(anchor), bool)  # windows that cross no document's end
        for e in ends[:-1]:
            inside[max(e - window + 1, 0):e] = False
        at = np.flatnonzero(inside)
        a = anchor[at]
        cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        lo, n = at[cut], np.diff(np.append(cut, len(at)))
        a = a[cut]
        which = np.searchsorted(ends, lo, side="right")
        content = mix(mix(whole[lo], whole[lo + n - 1]), (a - lo).astype(np.uint64) * np.uint64(1 << 20) + n.astype(np.uint64))
        doc = np.array([d for d, _, _ in slab])[which]
        shift = np.array([s for _, s, _ in slab]) - begins
        yield doc, grams[a].view(np.int64), content.view(np.int64), lo + shift[which], n


def window_ids(units: np.ndarray, places: list[tuple[int, int]], window: int,
               first: Callable[[np.ndarray], dict[int, np.ndarray]]) -> list[np.ndarray]:
    """Identifiers of the windows at each (first window, windows) place."""
    out = []
    for lo, n in places:
        out.append(widen(first(units[lo:lo + n + window - 1]), window)[:n].view(np.int64))
    return out


def row_id(text_col: str = "text", id_col: str = "doc_id") -> Column:
    """A key of a row: rows with the same key are equal in id and text."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def with_row_id(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(rid, doc_id, text): rows of one rid are equal in both columns."""
    return docs.select(row_id(text_col, id_col).alias("rid"),
                       F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def _batches(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def repeated_segments(docs: DataFrame, window: int, gram: int,
                      to_units: Callable[[str | None], np.ndarray],
                      first: Callable[[np.ndarray], dict[int, np.ndarray]], name: str) -> DataFrame:
    """(rid, lo, n, eid): runs of ``n`` windows from unit ``lo`` that all start
    elsewhere too; runs of one ``eid`` have equal content.  ``docs`` comes from
    ``with_row_id``."""
    prepare(docs.sparkSession)
    group_chars = SLAB_UNITS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "qid", "cid", "lo", "n"]

        def found(rids, units):
            rids = np.array(rids, dtype=np.int64)
            for doc, qid, cid, lo, n in segments(units, window, gram, first):
                yield _batches([rids[doc], qid, cid, lo.astype(np.int32), n.astype(np.int32)], names)

        for b in batches:
            rids, units, size = [], [], 0
            for rid, text in zip(b.column(0).to_pylist(), b.column(1)):
                rids.append(rid)
                units.append(to_units(text.as_py()))
                size += len(units[-1])
                if size >= group_chars:
                    yield from found(rids, units)
                    rids, units, size = [], [], 0
            yield from found(rids, units)

    cuts = written(docs.select("rid", "text").mapInArrow(cut, "rid long, qid long, cid long, lo int, n int"), f"{name}-segments")
    # counts are written before a join: Spark splits a hot key's rows only where
    # no aggregate needs them together
    buckets = written(cuts.groupBy("qid").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("qid"),
                      f"{name}-buckets")
    shared = written(cuts.join(buckets, "qid"), f"{name}-shared")
    discard(cuts, buckets)
    contents = shared.groupBy("qid", "cid").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("rid", "lo", "n")).alias("at"))
    contents = written(contents, f"{name}-contents")
    mixed = written(contents.groupBy("qid").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("qid"),
                    f"{name}-mixed")
    undecided = contents.join(mixed, "qid").select("at.rid", "at.lo", "at.n", "copies")
    places = undecided.groupBy("rid").agg(F.collect_list(F.struct("lo", "n", "copies")).alias("places"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["wid", "rid", "lo", "copies"]
        seen = set()  # equal rows meet in one task; more than one would give the same windows
        for b in batches:
            for rid, text, places_of in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if rid in seen:
                    continue
                seen.add(rid)
                units = to_units(text.as_py())
                todo = [(p["lo"], p["n"], p["copies"]) for p in places_of.as_py()]
                ids = window_ids(units, [p[:2] for p in todo], window, first)
                pos = np.concatenate([np.arange(lo, lo + n, dtype=np.int32) for lo, n, _ in todo])
                yield _batches([np.concatenate(ids), np.full(len(pos), rid, np.int64), pos,
                                np.repeat(np.array([p[2] for p in todo], np.int64), [len(x) for x in ids])], names)

    asked = (docs.select("rid", "text").join(places.hint("shuffle_hash"), "rid")
             .mapInArrow(windows, "wid long, rid long, lo int, copies long"))
    asked = written(asked, f"{name}-windows")
    again = written(asked.groupBy("wid").agg(F.sum("copies").alias("s")).where("s > 1").select("wid"), f"{name}-again")
    single = asked.where("copies = 1").join(again, "wid").select(
        "rid", "lo", F.lit(1).alias("n"), F.col("wid").alias("eid"))
    # a segment whose content has copies repeats as a whole
    whole = shared.join(contents.where("copies > 1").select("qid", "cid"), ["qid", "cid"]).select(
        "rid", "lo", "n", F.col("cid").alias("eid"))
    found = written(whole.unionByName(single), f"{name}-found")
    discard(shared, contents, mixed, asked, again)
    return found


def with_places(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with ``places``: the (lo, n) runs of windows of each row, null
    without any.  Equal rows have found the same runs: each is kept once, in
    the partial sets already."""
    per_row = found.groupBy("rid").agg(F.collect_set(F.struct("lo", "n")).alias("places"))
    return docs.join(per_row.hint("shuffle_hash"), "rid", "left")


def covered(size: int, places: list[dict], window: int) -> np.ndarray:
    """Which of ``size`` units lie in a window of one of the places."""
    edge = np.zeros(size + 1, np.int64)
    if places:
        lo = np.array([p["lo"] for p in places])
        n = np.array([p["n"] for p in places])
        np.add.at(edge, lo, 1)
        np.add.at(edge, lo + n + window - 1, -1)
    return np.cumsum(edge)[:size] > 0
