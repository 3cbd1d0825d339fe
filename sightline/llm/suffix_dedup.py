"""Suffix-array dedup: removal of byte strings that also start elsewhere, by
counting anchored digests.

This replaces bucket-pointer refinement: no suffixes are sorted into buckets
across the corpus and no pointers are refined in rounds.  Each task digests the
first eight bytes at every position (the bytes themselves), then 16 bytes from
the digests of 8 at the position and 8 later, and so on up to the length in
question.  Digests come from content, so all tasks agree and no suffix travels
for them.  Each window's smallest gram is its anchor; Spark counts anchors, then
whole segments and, where these differ, single windows (``repeats``).

Windows have one length: strings equal in more bytes need no further order,
which is all that removal asks.

Defined results: a null text is empty; texts shorter than ``length`` keep all
bytes; a repeated row is a document of its own, so its bytes start elsewhere;
cuts are made in bytes and may split a character; very long texts go through in
overlapping slabs; an empty table gives no row; columns other than id and text are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sightline.llm.repeats import covered, repeated_segments, with_places, with_row_id

LENGTH = 400
GRAM = 256
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def to_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def first_buckets(raw: np.ndarray) -> dict[int, np.ndarray]:
    """The buckets of the first eight bytes: the bytes as one number."""
    x = raw.astype(np.uint64)
    for h in (1, 2, 4):
        x = x[:-h] | (x[h:] << np.uint64(8 * h))
    return {8: x}


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(rid, lo, n, eid) for rows of ``with_row_id``: ``n`` strings of ``length``
    bytes from byte ``lo`` on that also start elsewhere."""
    return repeated_segments(docs, length, gram, to_bytes, first_buckets, "suffixes")


def remove_repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                            text_col: str = "text", id_col: str = "doc_id", kept: bool = True) -> DataFrame:
    """One row per document: sizes, removed bytes and runs, the SHA-256 of the
    kept bytes and (with ``kept``) those bytes."""
    rows = with_row_id(docs, text_col, id_col)
    marked = with_places(rows, repeated_strings(rows, length, gram)).select("doc_id", "text", "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")][:6 if kept else 5]
        for b in batches:
            out = []
            for doc_id, text, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                raw = to_bytes(text.as_py())
                found = places.as_py()
                if found:
                    gone = covered(len(raw), found, length)
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    rest = raw[~gone].tobytes()
                else:
                    runs, rest = 0, raw.tobytes()
                row = (doc_id, len(raw), len(raw) - len(rest), runs, hashlib.sha256(rest).hexdigest())
                out.append((*row, rest) if kept else row)
            if out:
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    schema = SCHEMA if kept else SCHEMA.rpartition(", ")[0]
    return marked.mapInArrow(cut, schema)
