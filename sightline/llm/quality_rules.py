"""Quality rules: a threshold table compiled into one Spark projection.

Each rule compares two counts of a text as ``100 * numerator <op> percent *
denominator``; all counts and all rules are built-in expressions evaluated in
one projection, without user functions and without a shuffle.

Defined results: a null or empty text has zero words and fails; a rule whose
denominator is zero holds.  Repeated rows each get their own result; columns
of the input are kept unless named like an output, which replaces them.  Very
long texts are split whole in memory, one row at a time; an empty table gives no
row; nothing depends on order, so there are no ties.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import let, let_all, words_of

# Function words of the languages the rules are meant for.
STOP_WORDS = {
    "en": "the of and to in a is that it was for on are with as at be this have from or by not".split(),
    "fr": "le la les de des du et un une que qui en est pour dans au avec ou ne se ce par sur".split(),
    "de": "der die das und zu den ein eine ist nicht mit von im dem des sich auf als auch für".split(),
    "es": "el la los las de del que y en un una no por con para al se su como lo es".split(),
}
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``100 * numerator <= percent * denominator`` (or >=)."""

    name: str
    numerator: str
    op: str
    percent: int
    denominator: str


# The threshold table: length, symbol, stop-word and line ratios.
RULES = (
    Rule("mean_word_min", "word_chars", ">=", 200, "n_words"),
    Rule("mean_word_max", "word_chars", "<=", 1500, "n_words"),
    Rule("symbol_ratio", "n_symbols", "<=", 10, "n_words"),
    Rule("stop_words", "n_stop_words", ">=", 2, "n_words"),
    Rule("dup_lines", "n_dup_lines", "<=", 60, "n_lines"),
)
BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def stop_word_forms() -> list[str]:
    plain = sorted({w for ws in STOP_WORDS.values() for w in ws})
    return plain + sorted({w.capitalize() for w in plain} - set(plain))


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a ``width``-word window that occurs twice or more
    in the text (all occurrences count).  Windows are sorted by a 64-bit hash,
    so equal ones are neighbours; then the covered positions are summed."""
    at = lambda i, k: F.element_at(words, (i + k).cast("int"))
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (width - 1)),
        lambda i: F.struct(F.xxhash64(*[at(i, k) for k in range(width)]).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        h = lambda j: F.get(s, j).getField("h")
        again = F.filter(s, lambda x, j: F.coalesce(h(j - 1) == x["h"], F.lit(False))
                         | F.coalesce(h(j + 1) == x["h"], F.lit(False)))
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(width), x - F.coalesce(F.get(p, j - 1), x - width))),
            F.lit(0), lambda a, x: a + x))

    return F.when(F.size(words) >= width, let(F.sort_array(windows), covered)).otherwise(F.lit(0))


def text_counts(text: Column) -> Column:
    """A struct of all counts the rules use."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    stops = stop_word_forms()

    def counts(w: Column, ln: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(ln).cast("long").alias("n_lines"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            repeated_window_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(stops))).cast("long").alias("n_stop_words"))

    return let_all([words_of(body), lines], counts)


def compile_rules(rules=RULES) -> Column:
    """One boolean: every rule of the table holds."""
    verdict = F.lit(True)
    for r in rules:
        left, right = F.lit(100) * F.col(r.numerator), F.lit(r.percent) * F.col(r.denominator)
        holds = left <= right if r.op == "<=" else left >= right
        verdict = verdict & (holds | (F.col(r.denominator) == 0))
    return verdict


def apply_rules(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``."""
    keep = [c for c in docs.columns if c not in (*COUNTS, "base_failed", "kept", "_counts") or c == text_col]
    counted = docs.select(*[F.col(f"`{c}`") for c in keep], text_counts(F.col(f"`{text_col}`")).alias("_counts"))
    flat = counted.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"_counts.{c}").alias(c) for c in COUNTS])
    failed = ((F.col("n_words") < BASE_MIN_WORDS)
              | (F.lit(100) * F.col("n_repeat_words") > F.lit(BASE_MAX_REPEAT_PERCENT) * F.col("n_words")))
    return (flat.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & compile_rules(rules)))


def oracle_sql() -> str:
    """The same projection as DuckDB SQL."""
    stops = ", ".join("'" + w + "'" for w in stop_word_forms())
    verdict = " AND ".join(
        f"(100 * {r.numerator} {r.op} {r.percent} * {r.denominator} OR {r.denominator} = 0)" for r in RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text,
        list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM d),
tri AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (
          SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n >= 2),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
          SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(words, lambda x: x IN ({stops})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {verdict} AS kept
FROM (SELECT *, (n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words)
             AS base_failed FROM c)
"""
