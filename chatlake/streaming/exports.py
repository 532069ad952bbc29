"""A drop folder of exports as a stream: each new file is a full snapshot, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatlake.operators import incremental, threads
from chatlake.operators.normalize import normalizer
from chatlake.session import materialize


def stream_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations (source, line_no, v) of JSON Lines files as they arrive."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rows = spark.readStream.format("text").load(folder)
    rows = rows.select(F.col("_metadata.file_path").alias("source"), F.lit(None).cast("bigint").alias("line_no"), F.try_parse_json("value").alias("v"))
    return rows.where(F.try_variant_get("v", "$", "struct<_:variant>").isNotNull())


def run(spark: SparkSession, folder: str, table: str, checkpoint: str, provider: str = "openai") -> StreamingQuery:
    """Keep ``table`` (Parquet of messages, one folder per batch) up to date: unchanged threads are skipped, others written anew.

    Readers take each thread from its latest batch (``current``). A batch that is run again overwrites its own folder.
    """

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        messages = materialize(normalizer(provider)(rows), "batch")
        index = threads.thread_index(messages)
        try:
            before = current(session, table, below=number)
            old = incremental.entries(threads.thread_index(before.drop("batch")))
        except Exception:  # noqa: BLE001 - the first batch finds no table
            old = incremental.entries(index).limit(0)
        fresh = incremental.classify(index, old).where("decision <> 'SKIP'").select("conversation_id")
        messages.join(fresh, "conversation_id", "left_semi").write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream_exports(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, below: int | None = None) -> DataFrame:
    """The messages of each thread in its latest batch."""
    rows = spark.read.parquet(table)
    if below is not None:
        rows = rows.where(F.col("batch") < below)
    last = rows.groupBy("conversation_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["conversation_id", "batch"])
