"""URL filters: a sorted digest array, memory-mapped and probed in batches.

``build_index`` writes the rules as two files: ``keys.u64`` holds the sorted
64-bit xxhash of each rule string (host followed by path prefix), and
``rules.bin`` the full strings in the same order with their verdicts.  Spark
serves both files to the executors; each Python worker maps the keys
(``numpy.memmap``), probes all candidate strings of a batch with one
vectorised binary search, and compares the stored full string at every hit, so
a digest collision can't decide.

The candidates of a URL are its host suffixes (cut at dots) times its path
prefixes of the lengths that rules have.  A rule fits its host and all
subdomains if the URL's path starts with the rule's path; the longest rule
string wins, then the longer host.  Rules come as a driver-side list: their
number is the caller's, not the data's.

Defined results: null, empty or scheme-less URLs have empty host and path, no
rule and the default verdict.  Repeated rows are judged alike, of equally long
rules there is one a host and path, very long URLs are read whole, other columns
stay unless named like an output, and an empty table gives no row.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import prepare

# The rules of the registered query, verdict and rule string.
QUERY_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def build_index(rules, folder: str) -> None:
    """Write ``keys.u64`` and ``rules.bin``; a rule given twice keeps its last verdict."""
    verdicts = {"".join(split_rule(r)): v for v, r in rules}
    rows = sorted((xxhash.xxh64_intdigest(r), r, v) for r, v in verdicts.items())
    np.array([k for k, _, _ in rows], dtype="<u8").tofile(os.path.join(folder, "keys.u64"))
    blobs = [f"{v}\t{r}".encode() for _, r, v in rows]
    offsets = np.cumsum([0, *map(len, blobs)], dtype="<u8")
    with open(os.path.join(folder, "rules.bin"), "wb") as f:
        f.write(struct.pack("<Q", len(blobs)))
        f.write(offsets.tobytes())
        f.write(b"".join(blobs))


class DigestIndex:
    """The two files, mapped read-only."""

    def __init__(self, keys_file: str, rules_file: str):
        empty = os.path.getsize(keys_file) == 0
        self.keys = np.zeros(0, "<u8") if empty else np.memmap(keys_file, dtype="<u8", mode="r")
        self.blob = np.memmap(rules_file, dtype=np.uint8, mode="r")
        n = int(self.blob[:8].view("<u8")[0])
        self.offsets = self.blob[8:8 + 8 * (n + 1)].view("<u8")
        self.body = 8 + 8 * (n + 1)
        paths = [len(split_rule(self.entry(i)[1])[1]) for i in range(n)]
        self.path_lengths = sorted(set(paths))

    def entry(self, i: int) -> tuple[str, str]:
        a, b = self.body + int(self.offsets[i]), self.body + int(self.offsets[i + 1])
        verdict, _, rule = self.blob[a:b].tobytes().decode().partition("\t")
        return verdict, rule

    def probe(self, strings: list[str]) -> list[tuple[str, str] | None]:
        """(verdict, rule) of each string, or None."""
        out: list[tuple[str, str] | None] = [None] * len(strings)
        if not strings or not len(self.keys):
            return out
        digests = np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), "<u8", len(strings))
        at = np.searchsorted(self.keys, digests)
        hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests))
        for i in hit:  # equal digests are neighbours: confirm by the stored string
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:
                verdict, rule = self.entry(j)
                if rule == strings[i]:
                    out[i] = (verdict, rule)
                    break
                j += 1
        return out

    def match(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
        owner: list[int] = []
        rank: list[tuple[int, int]] = []
        strings: list[str] = []
        for u, (host, path) in enumerate(zip(hosts, paths)):
            if not host and not path:
                continue
            labels = host.split(".")
            for k in range(len(labels)):
                suffix = ".".join(labels[k:])
                for n in self.path_lengths:
                    if n <= len(path):
                        owner.append(u)
                        rank.append((len(suffix) + n, len(suffix)))
                        strings.append(suffix + path[:n])
        best: list[tuple[str, str] | None] = [None] * len(hosts)
        order: dict[int, tuple[int, int]] = {}
        for u, r, found in zip(owner, rank, self.probe(strings)):
            if found and r > order.get(u, (-1, -1)):
                order[u], best[u] = r, found
        return best


def judge_urls(pages: DataFrame, rules=QUERY_RULES, url_col: str = "url",
               default: str = DEFAULT_VERDICT) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; clashing
    input columns are replaced, the others kept."""
    spark = pages.sparkSession
    prepare(spark)
    folder = tempfile.mkdtemp(prefix="url-index-")
    tag = os.path.basename(folder)
    build_index(rules, folder)
    names = []
    for f in ("keys.u64", "rules.bin"):  # Spark serves the files to every executor
        named = os.path.join(folder, f"{tag}-{f}")
        os.rename(os.path.join(folder, f), named)
        spark.sparkContext.addFile(named)
        names.append(os.path.basename(named))

    @F.pandas_udf("rule string, verdict string")
    def verdict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = DigestIndex(*[SparkFiles.get(n) for n in names])
        for host, path in batches:
            found = index.match(list(host), list(path))
            yield pd.DataFrame({"rule": [f and f[1] for f in found],
                                "verdict": [f[0] if f else default for f in found]})

    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict", "_judged")]
    url = F.col(f"`{url_col}`")
    located = pages.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"))
    judged = located.withColumn("_judged", verdict("host", "path"))
    return judged.select(*keep, "host", "path", "_judged.rule", "_judged.verdict")


def oracle_sql() -> str:
    rules = ", ".join(f"('{v}', '{r}', '{split_rule(r)[0]}', '{split_rule(r)[1]}')" for v, r in QUERY_RULES)
    return f"""
WITH rules(verdict, rule, rhost, rpath) AS (VALUES {rules}),
p AS (SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
      FROM pages),
m AS (SELECT page_id, rule, verdict,
        row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, length(rhost) DESC) AS n
      FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, m.rule AS rule, coalesce(m.verdict, '{DEFAULT_VERDICT}') AS verdict
FROM p LEFT JOIN (SELECT * FROM m WHERE n = 1) m ON p.page_id = m.page_id
"""
