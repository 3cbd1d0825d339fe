"""A training-data pipeline over ``documents``: each stage applies one corpus
operator to all rows that the stage before it kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``; stages keep row order open and repeat
alike after a lost executor.

Defined results, by stage: null and empty texts, and texts without a letter, go
with language ID, so no later stage sees them; other columns than those of
``documents`` are not read, whatever their names; very long texts go through
whole; of rows equal in id and text the near-duplicate stage keeps one, and of a
component's rows with the smallest doc_id (a null id is the largest) one;
decontamination looks at rows, not ids, so rows that share an id stay or go by
their own text; PII changes ``text`` and ``n_chars`` only; an empty table passes
through all stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontaminate, jaccard_join, language_id, packing, pii
from sightline.llm.common import table, written
from sightline.llm.repeats import row_id

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_LANGUAGE_SCORE = 1 / 3


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*DOCUMENT_COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (operator 4): texts without a language, or of which no
    language has ``MIN_LANGUAGE_SCORE`` of the words, go; ``lang`` becomes the
    predicted language."""
    found = language_id.predict(docs).where(
        (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return _documents(found.withColumn("lang", F.col("lang_pred")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (operator 9): of each component the row with the
    smallest doc_id stays; of equal rows, one."""
    firsts = (jaccard_join.similar_components(docs).where(F.col("rid") == F.col("first_rid"))
              .select("rid").distinct())
    kept = docs.withColumn("rid", row_id("text", "doc_id")).join(firsts, "rid", "left_semi")
    return _documents(kept.dropDuplicates(["rid"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (operator 8): documents that hold a window of
    a benchmark item go."""
    items = table(spark, sf_dir, "benchmark")
    hits = decontaminate.window_hits(docs, items).select("rid").distinct()
    return _documents(docs.withColumn("rid", row_id("text", "doc_id")).join(hits, "rid", "left_anti"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII (operator 10): every found span is replaced by its kind."""
    found = pii.find_pii(docs)
    clean = found.withColumn("text", pii.redact(F.col("text"), F.col("spans")))
    return _documents(clean.withColumn("n_chars", F.length("text").cast("long")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (operator 2): one row per piece of a document in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]

# Language ID and PII use trained models, packing a tokenizer: no SQL for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
