"""Threads: index, headers, run totals, order, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.session import materialize


def latest_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the one with the largest order columns; combined map-side, so a frequent key is no burden."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def dedupe_messages(messages: DataFrame) -> DataFrame:
    """One row per (provider_id, conversation_id, message_id): the one with the smallest time, then text."""
    keys = ["provider_id", "conversation_id", "message_id"]
    others = [c for c in messages.columns if c not in keys]
    return messages.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct("ts", "text")).alias("_row")).select(*keys, "_row.*").select(*messages.columns)


def thread_index(messages: DataFrame) -> DataFrame:
    """(provider_id, conversation_id, message_count, ts_min, ts_max, models) of each thread."""
    return messages.groupBy("provider_id", "conversation_id").agg(
        F.count("*").alias("message_count"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"), F.sort_array(F.collect_set(F.col("meta")["model"])).alias("models")
    )


def thread_headers(index: DataFrame) -> DataFrame:
    """Header lines of parsed.jsonl."""
    return index.select(F.lit("thread").alias("record_type"), "provider_id", "conversation_id", "message_count")


def run_stats(index: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """One row of totals: threads and messages, and with ``invalid`` the messages that were skipped."""
    stats = index.agg(F.count("*").alias("threads"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("messages"))
    return stats if invalid is None else stats.crossJoin(invalid.agg(F.count("*").alias("skipped")))


def ordered(messages: DataFrame) -> DataFrame:
    """Messages in the order of their threads: time (unknown last), then id; a total order, so runs agree."""
    return messages.orderBy("provider_id", "conversation_id", F.col("ts").asc_nulls_last(), "message_id")


def error_samples(errors: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` errors (a report of that many)."""
    return errors.orderBy("source", "line_no").limit(n)


def check_errors(errors: DataFrame, max_errors: int = 3) -> None:
    """Fail if there are more errors than allowed."""
    from chatlake.errors import AdapterError

    n = errors.limit(max_errors + 1).count()
    if n > max_errors:
        raise AdapterError(f"more than {max_errors} records could not be read")


def numbered(rows: DataFrame, groups: list[str], order: list[Column | str], name: str = "position") -> DataFrame:
    """``rows`` with their position in the group by ``order``, from 1, without bringing a group into one task.

    Rows are split by range over groups and order, numbered within each range, and moved up by what the group has in the ranges
    before. Order must be total, or ties get any of their numbers.
    """
    ranged = materialize(rows.repartitionByRange(*groups, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*groups, "_range").agg(F.count("*").alias("_n"))
    # A group has at most one row per range here.
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*groups, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(*order))
    out = ranged.withColumn("_local", local).join(starts, [*groups, "_range"])
    return out.withColumn(name, F.col("_before") + F.col("_local")).drop("_range", "_local", "_before")


def positions(messages: DataFrame) -> DataFrame:
    """Messages with ``position`` in their thread by (ts, message_id), unknown times last, from 1."""
    return numbered(messages, ["provider_id", "conversation_id"], [F.col("ts").asc_nulls_last(), F.col("message_id").asc_nulls_first()])


def fill_times(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """Messages without a time take that of their thread (conversation_id, create_time in seconds)."""
    t = threads.select("conversation_id", F.expr("try_cast(create_time * 1000 AS BIGINT)").alias("_thread_ts"))
    return messages.join(t, "conversation_id", "left").withColumn("ts", F.coalesce("ts", "_thread_ts")).drop("_thread_ts")


def enrich_models(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """Messages whose model is unknown take the thread's default (conversation_id, default_model_slug)."""
    t = threads.select("conversation_id", F.col("default_model_slug").alias("_default"))
    model = F.coalesce(F.col("meta")["model"], F.when(F.col("role") == "assistant", F.col("_default")))
    return messages.join(t, "conversation_id", "left").withColumn("meta", F.when(model.isNotNull(), F.create_map(F.lit("model"), model))).drop("_default")
