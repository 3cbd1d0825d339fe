"""Text-valued helpers: extensions, paths, human-readable sizes, report lines
(P1, F5, F6, F7, F8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions counted as pictures (SVG is left out on
# purpose, vector drawings are not hashed).
IMAGE_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff", ".tif",
    ".webp", ".heic", ".heif", ".avif", ".ico",
)

# Texts of the search report.  Size units step by 1024 below
# the last one; the match line reads as below.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")
MATCH_LINE = "  ✓ %s\n    Similarity: %s%% | Hamming distance: %s | Size: %s"

# Suffix of the last path component: a dot that is not the name's first
# character, followed by at least one character that is neither '.' nor '/'.
SUFFIX_PATTERN = r"[^/](\.[^./]+)$"


def file_extension(path: Column) -> Column:
    """Lower-cased suffix of the last path component, '' when there is none
    ('.jpg' alone has none, 'a.tar.jpeg' has '.jpeg', 'foo.' has none)."""
    return F.lower(F.regexp_extract(path, SUFFIX_PATTERN, 1))


def is_image_path(path: Column, extensions=IMAGE_EXTENSIONS) -> Column:
    return file_extension(path).isin(*[e.lower() for e in extensions])


def strip_query(url: Column) -> Column:
    """URL without its '?query' and '#fragment'."""
    return F.regexp_replace(url, r"[?#].*$", "")


def _one_decimal(x: Column) -> Column:
    # Python's format rounds half to even; bround first so Java's
    # formatter sees an already-rounded value.
    return F.format_string("%.1f", F.bround(x, 1))


def human_size(size: Column) -> Column:
    """Bytes as 'N B' below 1024, else one decimal in KB, MB, GB, TB
    (base 1024)."""
    v = size.cast("double")
    kb = v / 1024.0
    mb = kb / 1024.0
    gb = mb / 1024.0
    tb = gb / 1024.0
    b, k, m, g, t = (F.lit(" " + u) for u in SIZE_UNITS)
    return (F.when(v < 1024, F.concat(v.cast("bigint").cast("string"), b))
             .when(kb < 1024, F.concat(_one_decimal(kb), k))
             .when(mb < 1024, F.concat(_one_decimal(mb), m))
             .when(gb < 1024, F.concat(_one_decimal(gb), g))
             .otherwise(F.concat(_one_decimal(tb), t)))


def match_line(candidate: Column, similarity: Column, distance: Column, size: Column) -> Column:
    """Two-line text of one match."""
    return F.format_string(MATCH_LINE, candidate.cast("string"), _one_decimal(similarity),
                           distance.cast("string"), human_size(size))


def numbered_line(rank: Column, line: Column) -> Column:
    return F.concat(F.lit("  ["), rank.cast("string"), F.lit("] "), line)


# Characters a URI path keeps as they are (RFC 2396 path characters, the
# rule Spark's file paths follow); others below 0x80 are percent-encoded and
# non-ASCII characters are kept.
_URI_PATH_SAFE = frozenset(
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    "-_.!~*'()/;:@&=+$,")


def quote_path(path: str) -> str:
    """A path percent-encoded by the URI path rules, as Spark's file sources
    spell it in ``_metadata.file_path``."""
    out = []
    for ch in path:
        if ch in _URI_PATH_SAFE or ord(ch) > 127:
            out.append(ch)
        else:
            out.extend(f"%{b:02X}" for b in ch.encode("utf-8"))
    return "".join(out)


def normalize_uri(path: str) -> str:
    """Driver-side: a local path spelled as Spark's file sources spell it in
    ``_metadata.file_path`` ('file:' + absolute path, percent-encoded).  Links are
    not resolved: URIs compare as text.  Paths that already carry a scheme are
    returned unchanged."""
    import os

    if "://" in path or path.startswith("file:"):
        return path
    return "file:" + quote_path(os.path.abspath(path))
