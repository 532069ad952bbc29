"""Parsed threads (parsed.jsonl) and manifests."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.schemas import MANIFEST, PARSED


def read_parsed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Headers (the first of each file) and messages of the parsed.jsonl files at or under ``path``; bad lines are skipped.

    Both carry ``source`` and ``position``, the place of the line in its file: by the part of the file it was read from, then by its place there.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    rows = reader.schema(PARSED + ", _corrupt_record STRING").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    rows = rows.withColumns({"source": F.col("_metadata.file_path"), "position": F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))})
    rows = rows.where("_corrupt_record IS NULL").drop("_corrupt_record")
    first = rows.where("record_type = 'thread'").groupBy("source").agg(F.min_by(F.struct("provider_id", "conversation_id", "message_count"), "position").alias("h"))
    return first.select("source", "h.*"), rows.where("record_type = 'message'").drop("record_type", "message_count")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest.json; none if it is missing or unreadable."""
    if "://" not in path and not Path(path).exists():
        return spark.createDataFrame([], MANIFEST)
    try:
        whole = spark.read.text(path, wholetext=True)
        parsed = whole.select(F.from_json("value", "provider STRING, index STRUCT<threads: ARRAY<STRUCT<conversation_id: STRING, path: STRING, count: BIGINT, ts_min: BIGINT, ts_max: BIGINT>>>").alias("m"))
        return parsed.select(F.col("m.provider").alias("provider"), F.inline("m.index.threads"))
    except Exception:  # noqa: BLE001 - an unreadable manifest counts as none
        return spark.createDataFrame([], MANIFEST)
