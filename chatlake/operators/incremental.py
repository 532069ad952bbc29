"""Incremental runs: which threads are new, unchanged or to be replaced, and the manifest that results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(index: DataFrame, old: DataFrame, by: str = "count") -> DataFrame:
    """``index`` with ``decision``: NEW, SKIP or REPLACE against the manifest ``old``.

    By ``count`` a thread with the same number of messages is skipped; by ``time`` it must also end at the same time, and WARN
    marks one that now ends earlier. Of several old entries of a thread the first path counts.
    """
    known = old.groupBy("conversation_id").agg(F.min_by(F.struct("count", "ts_max"), "path").alias("_old"))
    rows = index.join(known, "conversation_id", "left")
    same = F.col("_old.count") == F.col("message_count")
    decision = F.when(F.col("_old").isNull(), "NEW")
    if by == "time":
        decision = decision.when(F.col("ts_max") < F.col("_old.ts_max"), "WARN")
        same = same & F.col("_old.ts_max").eqNullSafe(F.col("ts_max"))
    return rows.withColumn("decision", decision.when(same, "SKIP").otherwise("REPLACE")).withColumn("old_count", F.col("_old.count")).drop("_old")


def entries(index: DataFrame) -> DataFrame:
    """Manifest entries of threads."""
    from chatlake.functions.text import sanitize_filename

    path = F.concat(F.lit("thread-"), sanitize_filename(F.col("conversation_id")), F.lit("/parsed.jsonl"))
    return index.select(F.col("provider_id").alias("provider"), "conversation_id", path.alias("path"), F.col("message_count").alias("count"), "ts_min", "ts_max")


def merge_manifest(classified: DataFrame, old: DataFrame) -> DataFrame:
    """Entries after the run: new and replaced threads as they are now, all others carried forward."""
    fresh = entries(classified.where("decision <> 'SKIP'"))
    kept = old.join(fresh.select("conversation_id"), "conversation_id", "left_anti")
    return fresh.unionByName(kept.select(*fresh.columns))
