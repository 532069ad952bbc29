"""Splitting threads into parts by size or number of messages.

The packing is a running decision per thread: each block joins the open part or opens the next.
It needs only the sizes of the blocks, never their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.sizes import parse_size
from chatlake.functions.text import sanitize_filename
from chatlake.operators.render import blocks, front_matter, ordered_text

#: Bytes that front matter is taken for.
FRONT_MATTER = 1024
#: Messages of a thread that ``assign_parts_in_row`` packs in one value.
CHUNK = 256


@dataclass(frozen=True)
class SplitSpec:
    """How to split: no mode is no split; 0 is no limit."""

    mode: str | None = None
    size_limit: int = 0
    count_limit: int = 0
    soft_overflow: float = 0.20
    hard: bool = False
    tiny_tail: int = 20

    @classmethod
    def parse(cls, spec: str | None, **options) -> SplitSpec:
        """Of ``auto``, ``size=4M``, ``count=1500`` or nothing."""
        s = (spec or "").strip().lower()
        if not s:
            return cls(**options)
        if s == "auto":
            return cls("auto", parse_size("4M"), 1500, **options)
        name, _, value = s.partition("=")
        if name == "size" and value:
            return cls("size", size_limit=parse_size(value), **options)
        if name == "count" and value.isdigit():
            return cls("count", count_limit=int(value), **options)
        raise ValueError(f"invalid split: {spec}")

    @property
    def soft_limit(self) -> int:
        return int(self.size_limit * (1 + self.soft_overflow))


class Packer:
    """The running decision of one thread of ``total`` blocks."""

    def __init__(self, spec: SplitSpec, total: int, overhead: int = FRONT_MATTER):
        self.spec, self.total, self.overhead = spec, total, overhead
        self.part, self.used, self.held, self.seen = 1, 0, 0, 0

    def add(self, size: int) -> int:
        """Part number of the next block, from 1."""
        s, needed = self.spec, self.used + size + self.overhead
        self.seen += 1
        too_large = bool(s.size_limit) and needed > s.size_limit
        too_many = not too_large and bool(s.count_limit) and self.held >= s.count_limit
        if too_large or too_many:
            tolerated = bool(s.size_limit) and not too_many and needed <= s.soft_limit
            near_end = self.total - self.seen <= s.tiny_tail
            if self.held and (s.hard or not (tolerated or near_end)):
                self.part, self.used, self.held = self.part + 1, 0, 0
        self.used, self.held = self.used + size, self.held + 1
        return self.part


def pack_start() -> Column:
    """The state of ``Packer`` before the first block, as an expression."""
    zero = F.lit(0).cast("bigint")
    return F.struct(F.lit(1).alias("part"), zero.alias("used"), zero.alias("held"), zero.alias("seen"))


def pack_next(s: Column, b: Column, total: Column, spec: SplitSpec, overhead: int = FRONT_MATTER) -> Column:
    """``Packer.add`` as an expression: the state after a block of ``b`` bytes. ``total`` is read at every step, so it must be a column."""
    over_size = (s["used"] + b + overhead > spec.size_limit) if spec.size_limit else F.lit(False)
    over_count = (~over_size & (s["held"] >= spec.count_limit)) if spec.count_limit else F.lit(False)
    within = (~over_count & (s["used"] + b + overhead <= spec.soft_limit)) if spec.size_limit else F.lit(False)
    tail = total - (s["seen"] + 1) <= spec.tiny_tail
    flush = (over_size | over_count) & (s["held"] > 0)
    if not spec.hard:
        flush = flush & ~(within | tail)
    return F.struct((s["part"] + flush.cast("int")).alias("part"), (F.when(flush, 0).otherwise(s["used"]) + b).alias("used"), (F.when(flush, 0).otherwise(s["held"]) + 1).alias("held"), (s["seen"] + 1).alias("seen"))


def pack_states(chunks: Column, total: Column, spec: SplitSpec, overhead: int = FRONT_MATTER) -> Column:
    """The state in which each chunk begins, of the chunks of sizes of one thread; copied once per chunk, not once per block."""
    state = "struct<part:int,used:bigint,held:bigint,seen:bigint>"
    start = F.struct(pack_start().alias("now"), F.array().cast(f"array<{state}>").alias("out"))

    def step(s: Column, sizes: Column) -> Column:
        now = F.aggregate(sizes, s["now"], lambda t, b: pack_next(t, b, total, spec, overhead))
        return F.struct(now.alias("now"), F.concat(s["out"], F.array(s["now"])).alias("out"))

    return F.aggregate(chunks, start, step, lambda s: s["out"])


def pack_column(sizes: Column, start: Column, total: Column, spec: SplitSpec, overhead: int = FRONT_MATTER) -> Column:
    """The part numbers of a chunk of sizes that begins in the state ``start``. Each step copies the numbers so far, so chunks are short."""
    first = F.struct(start.alias("now"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        now = pack_next(s["now"], b, total, spec, overhead)
        return F.struct(now.alias("now"), F.concat(s["out"], F.array(now["part"])).alias("out"))

    return F.aggregate(sizes, first, step, lambda s: s["out"])


def assign_parts_in_row(messages: DataFrame, spec: SplitSpec, tz: str = "UTC", formatting: str = "light", overhead: int = FRONT_MATTER) -> DataFrame:
    """``assign_parts`` inside the JVM, in time linear in the length of a thread.

    A thread is numbered by a window and cut into chunks. Only the sizes of its chunks come into one row (8 bytes a message),
    where they are folded to the state in which each chunk begins; from there the chunks are packed one by one.
    """
    # Structs compare equal where their fields are null, so threads of no provider are kept by the join.
    thread = F.struct("provider_id", "conversation_id").alias("thread")
    place = F.row_number().over(Window.partitionBy("thread").orderBy(F.col("ts").asc_nulls_last(), "message_id"))
    placed = blocks(messages, tz, formatting).select(thread, "ts", "message_id", "bytes").withColumn("place", place)
    item = F.struct("place", "ts", "message_id", "bytes")
    chunks = placed.groupBy("thread", F.expr(f"int((place - 1) div {CHUNK})").alias("chunk")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    sizes = F.transform("items", lambda x: x["bytes"])
    whole = chunks.groupBy("thread").agg(F.array_sort(F.collect_list(F.struct("chunk", sizes.alias("sizes")))).alias("chunks"), F.sum(F.size("items")).alias("total"))
    states = pack_states(F.transform("chunks", lambda x: x["sizes"]), F.col("total"), spec, overhead)
    begun = whole.select("thread", "total", F.posexplode(states).alias("chunk", "start"))
    parts = pack_column(sizes, F.col("start"), F.col("total"), spec, overhead)
    out = chunks.join(begun, ["thread", "chunk"]).withColumn("parts", parts).select("thread", F.explode(F.arrays_zip("items", "parts")).alias("x"))
    return out.select("thread.provider_id", "thread.conversation_id", "x.items.ts", "x.items.message_id", "x.items.bytes", F.col("x.parts").alias("part_index"))


def assign_parts(messages: DataFrame, spec: SplitSpec, tz: str = "UTC", formatting: str = "light", overhead: int = FRONT_MATTER) -> DataFrame:
    """(provider_id, conversation_id, ts, message_id, bytes, part_index) in order of (ts, message_id) within each thread.

    Packing is a sequential decision, so a thread's sizes pass through one task; they are sorted by Spark (which spills) and
    streamed, and only the state of the open part is kept. Texts stay in the JVM.
    """
    b = blocks(messages, tz, formatting)
    counts = b.groupBy("provider_id", "conversation_id").agg(F.count("*").alias("_total"))
    rows = b.select("provider_id", "conversation_id", "ts", "message_id", "bytes").join(counts, ["provider_id", "conversation_id"])
    rows = rows.repartition("provider_id", "conversation_id").sortWithinPartitions("provider_id", "conversation_id", F.col("ts").asc_nulls_last(), "message_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, packer = None, None
        for f in frames:
            out = []
            for p, c, size, total in zip(f["provider_id"], f["conversation_id"], f["bytes"], f["_total"]):
                if (p, c) != key:
                    key, packer = (p, c), Packer(spec, total, overhead)
                out.append(packer.add(size))
            yield f[["provider_id", "conversation_id", "ts", "message_id", "bytes"]].assign(part_index=pd.Series(out, index=f.index, dtype="int32"))

    return rows.mapInPandas(run, "provider_id string, conversation_id string, ts bigint, message_id string, bytes bigint, part_index int")


def part_summary(assigned: DataFrame) -> DataFrame:
    """(conversation_id, part_index, part_total, message_count, bytes, file_name) of assigned blocks."""
    parts = assigned.groupBy("conversation_id", "part_index").agg(F.count("*").alias("message_count"), F.sum("bytes").alias("bytes"))
    totals = assigned.groupBy("conversation_id").agg(F.max("part_index").alias("part_total"))
    return parts.join(totals, "conversation_id").withColumn("file_name", file_name(F.col("conversation_id"), F.col("part_index"), F.col("part_total")))


def file_name(cid: Column, index: Column, total: Column) -> Column:
    """``thread-<id>.md``, with ``__partNN`` where there are several."""
    suffix = F.when(total > 1, F.concat(F.lit("__part"), F.lpad(index.cast("string"), F.greatest(F.lit(2), F.length(index.cast("string"))), F.lit("0")))).otherwise(F.lit(""))
    return sanitize_filename(F.concat(F.lit("thread-"), cid, suffix, F.lit(".md")))


def part_documents(messages: DataFrame, spec: SplitSpec, generated_at: str, tz: str = "UTC", formatting: str = "light") -> DataFrame:
    """(provider_id, conversation_id, part_index, part_total, message_count, bytes, markdown, file_name) of each part.

    The range and models of the front matter are the thread's. ``generated_at`` is given by the caller, so runs agree.
    Message ids are taken as unique within a thread (see ``dedupe_messages``).
    """
    assigned = assign_parts(messages, spec, tz, formatting)
    threads = blocks(messages, tz, formatting).groupBy("provider_id", "conversation_id").agg(F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"), F.sort_array(F.collect_set("model")).alias("models"))
    totals = assigned.groupBy("provider_id", "conversation_id").agg(F.max("part_index").alias("part_total"))
    key = ["provider_id", "conversation_id", "message_id"]
    bodies = blocks(messages, tz, formatting).select(*key, "ts", "block").join(assigned.select(*key, "part_index"), key)
    # A part is bounded by the split, so its body is one value.
    parts = bodies.groupBy("provider_id", "conversation_id", "part_index").agg(F.count("*").alias("message_count"), ordered_text().alias("body"))
    rows = parts.join(threads, ["provider_id", "conversation_id"]).join(totals, ["provider_id", "conversation_id"])
    extra = [("part_index", F.col("part_index").cast("string")), ("part_total", F.col("part_total").cast("string")), ("generated_at_utc", F.lit(generated_at)), ("tz", F.lit(tz))]
    md = F.concat(front_matter(extra, "message_count"), F.col("body"))
    return rows.select("provider_id", "conversation_id", "part_index", "part_total", "message_count", F.octet_length(md).cast("bigint").alias("bytes"), md.alias("markdown"), file_name(F.col("conversation_id"), F.col("part_index"), F.col("part_total")).alias("file_name"))
