"""Benchmark decontamination: a prefix-filtered join of benchmark windows with
the words of all documents, as DataFrame expressions only.

Each item is cut into windows of ``width`` consecutive words (an item of fewer
words is one window).  A document contains a window only if it contains the
window's rarest word, so that word alone is the window's join prefix:

1. count, over all documents, the words that any window holds;
2. order each window's words by that count and keep the rarest one with its
   offset; windows with a word that no document holds drop out here;
3. join the documents' words with the prefix words; the word's position minus
   its offset is the only possible start, which must lie inside the document
   with room for the whole window (positional and length bounds);
4. verify the whole window word by word at that start.

Only the windows are broadcast, after their size was measured: beyond
``max_broadcast_bytes`` they are joined in blocks, each below that bound, each
against all documents.  A document's words are exploded inside one task and
never shuffled; hits are grouped by row (``row_id``: its id and its text), so
rows that share a null or repeated id keep their own.

Defined results: null and empty texts have no words, so nothing is hit; null
items have no windows; repeated items and documents each count; other columns
of the inputs are ignored by name clashes, as only the named ones are read.
Very long texts are split whole, and their words joined as rows of their own; of
equally rare words of a window the first by letters leads; without documents
there is no row, without items nothing is hit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import discard, words_of, written
from sightline.llm.repeats import row_id

# Fixed value: the separators of the contract's words, with A-Z kept.
WORD_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
MAX_BROADCAST_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; all other letters unchanged."""
    return (F.when(F.octet_length(text) == F.length(text), F.lower(text))
            .otherwise(F.translate(text, _UPPER, _LOWER)))


def word_list(text: Column) -> Column:
    return words_of(ascii_lower(text), WORD_SEPARATORS)


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(window, items): each distinct window with the ids that hold it."""
    listed = items.select(F.col("item_id"), word_list(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    cut = listed.select("item_id", F.explode(starts).alias("s"), "w").select(
        "item_id", F.slice("w", F.col("s"), width).alias("window"))
    return cut.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def document_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(row_id(text_col, id_col).alias("rid"), word_list(F.col(f"`{text_col}`")).alias("w"))


def word_counts(listed: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """How often each word of the windows occurs in the documents."""
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    # the outer form: for a plain explode Spark adds a filter on the array's size,
    # which splits every text a second time
    said = listed.select(F.explode_outer("w").alias("word"))
    count = lambda df: df.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    if small:
        return count(said.join(F.broadcast(vocabulary), "word", "left_semi"))
    return count(said).join(vocabulary, "word", "left_semi")  # each task's words are counted before the shuffle


def window_prefixes(windows: DataFrame, counts: DataFrame, small: bool) -> DataFrame:
    """Each window that can occur with its rarest word and that word's offset.
    ``small``: the windows, whose vocabulary bounds the counts, may be broadcast."""
    words = windows.select("window", "items", F.posexplode("window").alias("o", "word"))
    ranked = words.join(F.broadcast(counts) if small else counts, "word", "left")
    return (ranked.groupBy("window")
            .agg(F.first("items").alias("items"),
                 F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "o")).alias("rarest"))
            .where(F.col("rarest.n") > 0)
            .select("window", "items", F.col("rarest.word").alias("word"), F.col("rarest.o").alias("o")))


def window_hits(docs: DataFrame, items: DataFrame, width: int = WINDOW, id_col: str = "doc_id",
                text_col: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(rid, start, len, items): every occurrence of a window, with the
    ``row_id`` of its document and its 0-based word position."""
    windows = item_windows(items, width)
    size = windows.agg(
        F.coalesce(F.sum(F.aggregate("window", F.lit(64), lambda a, x: a + F.octet_length(x) + 24)
                         + 16 * F.size("items")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, math.ceil(size / max_broadcast_bytes))
    listed = document_words(docs, id_col, text_col)
    # written: no aggregate stands below the join on words, so a hot word's rows may be split
    counts = written(word_counts(listed, windows, blocks == 1), "window-words")
    prefixes = written(window_prefixes(windows, counts, blocks == 1), "window-prefixes")  # at most as large as the windows
    discard(counts)
    placed = listed.select("rid", "w", F.posexplode_outer("w").alias("pos", "word"))
    found = None
    for b in range(blocks):
        block = prefixes if blocks == 1 else prefixes.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
        start, n = F.col("pos") - F.col("o"), F.size("window")
        hits = (placed.join(F.broadcast(block), "word")
                .where((start >= 0) & (start + n <= F.size("w")))
                .where(F.slice("w", start + 1, n) == F.col("window"))
                .select("rid", start.alias("start"), n.alias("len"), "items"))
        found = hits if found is None else found.unionByName(hits)
    return found


def covered_words(places: Column) -> Column:
    """How many words the (start, len) places cover together."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc, p):
        end = p["start"] + p["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"),
                        (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], p["start"]))).alias("n"))

    return F.aggregate(F.sort_array(places), zero, step, lambda acc: acc["n"])


def contaminated_words(docs: DataFrame, items: DataFrame, width: int = WINDOW, id_col: str = "doc_id",
                       text_col: str = "text", **bounds) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, item_ids, contaminated."""
    hits = window_hits(docs, items, width, id_col, text_col, **bounds)
    per_doc = hits.groupBy(F.col("rid").alias("hit_rid")).agg(
        F.collect_set(F.struct("start", "len")).alias("places"), F.collect_set("items").alias("sets"))
    ids = F.array_distinct(F.flatten("sets"))
    per_doc = per_doc.select(
        "hit_rid", covered_words(F.col("places")).alias("n_hit"),
        F.sort_array(F.transform(ids, lambda x: x.cast("string"))).alias("item_ids"))
    sizes = docs.select(row_id(text_col, id_col).alias("rid"), F.col(f"`{id_col}`").alias("doc_id"),
                        F.size(word_list(F.col(f"`{text_col}`"))).cast("long").alias("n_words"))
    out = sizes.join(per_doc, sizes["rid"] == per_doc["hit_rid"], "left")
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        item_ids.alias("item_ids"), F.size(item_ids).cast("long").alias("n_items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def digest_columns(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def oracle_sql() -> str:
    words = ("list_filter(string_split_regex(translate(coalesce(text, ''), "
             f"'{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')")
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[s:s + {WINDOW - 1}] AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT doc_id, s, n, w[s:s + n - 1] AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, n, item_id FROM dw JOIN bw USING (win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
          SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
