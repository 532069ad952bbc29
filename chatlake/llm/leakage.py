"""Problem 9: passages of held-out items inside documents.

Method: Wu-Manber multi-pattern search over words. The patterns are the passages that only one
item holds: those of ``width`` words and, where other items hold these too, the longer ones that
begin with them. A shift table over blocks of two words skips positions at which no first
``width`` words can end, buckets by the hash of the last block select the passages to test, and
the words themselves are compared to confirm, those beyond the first ``width`` included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.session import materialize

#: Words in a row that make a leak.
WIDTH = 12
#: Words in a block of the shift table.
BLOCK = 2
#: Passages searched for in one pass; more of them take more passes over the documents, so the broadcast is bounded.
PASSAGES_A_PASS = 400_000

_WORD = re.compile(r"[^\W_]+").findall


def words(text: str) -> list[str]:
    """Runs of letters and digits of ``text``, without case."""
    return _WORD(text.casefold())


class Matcher:
    """Shift table and suffix buckets of the first ``width`` words of passages, which may be longer."""

    def __init__(self, passages: list[tuple[int, tuple[str, ...]]], width: int = WIDTH, block: int = BLOCK):
        self.width, self.block = width, min(block, width)
        self.code: dict[str, int] = {}
        for _, p in passages:
            for w in p:
                self.code.setdefault(w, len(self.code) + 1)
        self.base = len(self.code) + 1
        self.longest = width - self.block + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        for item, p in passages:
            ids = tuple(self.code[w] for w in p)
            for end in range(self.block, width + 1):
                key = self.key(ids, end)
                self.shift[key] = min(self.shift.get(key, self.longest), width - end)
            self.bucket.setdefault(self.key(ids, width), []).append((ids, item))

    def key(self, ids, end: int) -> int:
        """The block of words that ends before ``end``, as one number."""
        k = 0
        for i in range(end - self.block, end):
            k = k * self.base + ids[i]
        return k

    def search(self, text: str) -> set[int]:
        """Items of which a passage stands in ``text``."""
        get = self.code.get
        ids = [get(w, 0) for w in words(text)]
        found: set[int] = set()
        end, n = self.width, len(ids)
        shift, longest = self.shift, self.longest
        while end <= n:
            key = self.key(ids, end)
            step = shift.get(key, longest)
            if step:
                end += step
                continue
            start = end - self.width
            here = tuple(ids[start:end])
            for passage, item in self.bucket[key]:
                if passage == (here if len(passage) == self.width else tuple(ids[start : start + len(passage)])):
                    found.add(item)
            end += 1
        return found


def own_passages(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "prompt") -> DataFrame:
    """(item_id, passage): the runs of at least ``width`` words that the prompts of exactly one item hold, words joined by a space.

    From each word on, the shortest such run; some longer ones may come with it. Runs of ``width`` words are counted first; those that several items
    hold are lengthened, by more words each time, until they are one item's own or the prompt ends.
    """
    found = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    found = found.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("prompt"))
    prompts = materialize(found.withColumn("n", F.monotonically_increasing_id()), "prompts").withColumn("starts", F.lit(None).cast("array<int>"))
    out, shortest, longest = None, width, width
    while True:
        runs = materialize(_runs(prompts, shortest, longest), "runs")
        holders = runs.groupBy("passage").agg(F.min("item_id").alias("item_id"), F.max("item_id").alias("other"))
        own = holders.where("item_id = other").select("item_id", "passage")
        out = own if out is None else out.unionByName(own)
        # Where even the longest run is shared and the prompt goes on.
        shared = holders.where("item_id <> other").select("passage")
        starts = runs.where("more").join(shared, "passage", "left_semi").groupBy("n").agg(F.collect_list("start").alias("starts"))
        prompts = materialize(prompts.drop("starts").join(starts, "n"), "starts")
        if not prompts.limit(1).count():
            return out
        shortest, longest = longest + 1, 2 * longest


def _runs(prompts: DataFrame, shortest: int, longest: int) -> DataFrame:
    """(n, item_id, start, passage, more): the runs of ``shortest`` to ``longest`` words from each of ``starts`` (null: all); ``more``: the longest, and a word follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, item, text, starts in zip(*(c.to_pylist() for c in batch.columns)):
                w = words(text)
                rows = [(i, k) for i in (range(len(w)) if starts is None else starts) for k in range(shortest, min(longest, len(w) - i) + 1)]
                for at in range(0, len(rows), 10_000):
                    some = rows[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n] * len(some), pa.int64()), pa.array([item] * len(some), pa.int64()), pa.array([i for i, _ in some], pa.int32()), pa.array([" ".join(w[i : i + k]) for i, k in some], pa.string()), pa.array([k == longest and i + k < len(w) for i, k in some], pa.bool_())],
                        names=["n", "item_id", "start", "passage", "more"],
                    )

    return prompts.select("n", "item_id", "prompt", "starts").mapInArrow(run, "n bigint, item_id bigint, start int, passage string, more boolean")


def leaked_items(documents: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id), distinct: the documents that hold a passage of an item's own, of ``width`` words or more.

    Null ids are left out and null texts hold nothing. Items of the same prompt have no passage of their own. Every document
    is searched whole; passages beyond ``PASSAGES_A_PASS`` are searched in further passes.
    """
    spark: SparkSession = documents.sparkSession
    own = materialize(own_passages(items, width), "passages")
    passes = max(1, -(-own.count() // PASSAGES_A_PASS))
    docs = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for k in range(passes):
        found, sent = _search(spark, docs, own.where(F.pmod(F.xxhash64("passage"), F.lit(passes)) == k), width)
        if passes > 1:
            # One pass at a time: its passages are gone before those of the next are gathered.
            found = materialize(found, "leaks")
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def _search(spark: SparkSession, docs: DataFrame, own: DataFrame, width: int) -> tuple[DataFrame, object]:
    """(doc_id, item_id) of the passages of one pass, at most about ``PASSAGES_A_PASS``, and what was sent to the workers."""
    sent = spark.sparkContext.broadcast([(r.item_id, tuple(r.passage.split(" "))) for r in own.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, width)
        for batch in batches:
            docs_, items_ = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for item in matcher.search(text.as_py()):
                    docs_.append(doc)
                    items_.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(items_, pa.int64())], names=["doc_id", "item_id"])

    return docs.mapInArrow(run, "doc_id bigint, item_id bigint"), sent
