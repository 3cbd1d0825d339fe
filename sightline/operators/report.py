"""Run counters and result documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import match_line, numbered_line

# Keys of the JSON report, in this order.
MATCH_FIELDS = ["reference", "candidate", "similarity_pct", "distance", "file_size"]
STATS_FIELDS = ["total_files", "images_scanned", "images_failed", "matches_found",
                "elapsed_seconds"]


def search_stats(outcomes: DataFrame, ok: Column, matched: Column,
                 elapsed_seconds: float | Column) -> DataFrame:
    """One row of counters over the candidate outcomes (A1): every row is a
    candidate file; ``ok`` marks a hashed one, ``matched`` one that reaches
    the threshold.  ``speed_img_s`` rounds half to even (A2)."""
    el = elapsed_seconds if isinstance(elapsed_seconds, Column) else F.lit(float(elapsed_seconds))
    agg = outcomes.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(ok).alias("images_scanned"),
        F.count_if(~ok).alias("images_failed"),
        F.count_if(ok & matched).alias("matches_found"))
    return (agg.withColumn("elapsed_seconds", el.cast("double"))
               .withColumn("speed_img_s",
                           F.bround(F.col("images_scanned") / F.greatest(F.col("elapsed_seconds"),
                                                                         F.lit(0.001)), 0)))


def match_report(ranked: DataFrame) -> DataFrame:
    """``rank`` and the numbered text of each match."""
    line = match_line(F.col("candidate"), F.col("similarity_pct"), F.col("distance"),
                      F.col("file_size"))
    return ranked.select("rank", numbered_line(F.col("rank"), line).alias("line"))


def json_rows(ranked: DataFrame) -> DataFrame:
    """One JSON object per match, keys in a fixed order."""
    return ranked.select("rank", F.to_json(F.struct(*[F.col(c) for c in MATCH_FIELDS])).alias("json"))


def write_json_report(ranked: DataFrame, stats: DataFrame, path: str) -> None:
    """Matches as JSON lines under ``path/matches`` and the counters under
    ``path/stats``: written by the executors, nothing gathered on the
    driver."""
    ranked.select("rank", *MATCH_FIELDS).write.mode("overwrite").json(f"{path}/matches")
    stats.select(*STATS_FIELDS).coalesce(1).write.mode("overwrite").json(f"{path}/stats")


def json_document(ranked: DataFrame, stats: DataFrame) -> str:
    """The single ``{"matches": [...], "stats": {...}}`` text of a search, with
    every match.  The text is one string of the caller's process; results too
    large for that go through ``write_json_report``."""
    rows = ranked.orderBy("rank").select(*MATCH_FIELDS).toLocalIterator()
    s = stats.select(*STATS_FIELDS).first()
    return json.dumps({
        "matches": [{k: (str(r[k]) if k in ("reference", "candidate") else r[k])
                     for k in MATCH_FIELDS} for r in rows],
        "stats": {k: s[k] for k in STATS_FIELDS},
    }, indent=2)
