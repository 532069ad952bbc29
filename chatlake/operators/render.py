"""Markdown of messages and threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions.text import light_format, text_or_parts, yaml_list
from chatlake.functions.times import iso_utc, local_human
from chatlake.operators.threads import positions


def block(tz: str = "UTC", formatting: str = "light", locale: str = "iso") -> Column:
    """A message as Markdown: heading with role and local time, its ids, its text."""
    text = text_or_parts(F.col("text"), F.col("content.parts"))
    text = light_format(text) if formatting == "light" else text
    ids = F.concat_ws(
        "\n",
        F.when(F.coalesce("message_id", F.lit("")) != "", F.concat(F.lit("- message_id: "), "message_id")),
        F.when(F.coalesce("parent_id", F.lit("")) != "", F.concat(F.lit("- parent_id: "), "parent_id")),
    )
    head = F.concat(F.lit("## ["), F.coalesce("role", F.lit("unknown")), F.lit("] "), local_human(F.col("ts"), tz, locale), F.lit("\n"))
    return F.concat(head, F.when(ids != "", F.concat(ids, F.lit("\n\n"))).otherwise(F.lit("")), text, F.lit("\n\n"))


def blocks(messages: DataFrame, tz: str = "UTC", formatting: str = "light", locale: str = "iso") -> DataFrame:
    """(provider_id, conversation_id, ts, message_id, model, block, bytes) of messages."""
    b = messages.withColumn("block", block(tz, formatting, locale))
    return b.select("provider_id", "conversation_id", "ts", "message_id", F.col("meta")["model"].alias("model"), "block", F.octet_length("block").cast("bigint").alias("bytes"))


def front_matter(extra: list[tuple[str, Column]] = (), messages: str = "messages") -> Column:
    """Front matter of a thread row (conversation_id, provider_id, message_count, models, ts_min, ts_max) with further lines."""
    lines = [
        F.lit("---"),
        F.concat(F.lit("thread: "), "conversation_id"),
        F.concat(F.lit("provider: "), "provider_id"),
        F.concat(F.lit(f"{messages}: "), F.col("message_count").cast("string")),
        F.concat(F.lit("models: "), yaml_list(F.col("models"))),
        F.concat(F.lit("range: "), iso_utc(F.col("ts_min")), F.lit(" 〜 "), iso_utc(F.col("ts_max"))),
        *(F.concat(F.lit(f"{k}: "), v) for k, v in extra),
        F.lit("---"),
        F.lit(""),
    ]
    return F.concat_ws("\n", *lines)


def ordered_text(column: str = "block") -> Column:
    """Aggregate: texts of a group joined in order of (ts, message_id), unknown times last."""
    rows = F.collect_list(F.struct(F.col("ts").isNull().alias("late"), "ts", "message_id", column))
    return F.array_join(F.transform(F.array_sort(rows), lambda x: x[column]), "")


def thread_chunks(messages: DataFrame, tz: str = "UTC", formatting: str = "light") -> DataFrame:
    """(provider_id, conversation_id, position, chunk): each thread's document in pieces, front matter at position 0, then its blocks.

    Joined in order of position the chunks are the document; no task holds a document as a whole, however long the thread.
    """
    b = blocks(messages, tz, formatting)
    threads = b.groupBy("provider_id", "conversation_id").agg(F.count("*").alias("message_count"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"), F.sort_array(F.collect_set("model")).alias("models"))
    head = threads.select("provider_id", "conversation_id", F.lit(0).cast("bigint").alias("position"), front_matter().alias("chunk"))
    body = positions(b).select("provider_id", "conversation_id", "position", F.col("block").alias("chunk"))
    return head.unionByName(body)


def preview(messages: DataFrame, limit: int, tz: str = "UTC", formatting: str = "light") -> DataFrame:
    """(conversation_id, messages, bytes, parts): how large each thread's body is and how many parts of ``limit`` bytes it may take."""
    b = blocks(messages, tz, formatting).groupBy("conversation_id").agg(F.count("*").alias("messages"), F.sum("bytes").alias("bytes"))
    return b.withColumn("parts", F.greatest(F.lit(1).cast("bigint"), F.expr(f"bytes div {max(1, limit)}")))
