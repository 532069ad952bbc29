"""Problem 3: ordered conversations from message rows.

Method: the rows that one export file holds of a thread are a fragment, in order of (ts, message_id).
The overlap graph links a fragment to the one that reaches furthest among those that begin before
it: the suffix of the one must equal the prefix of the other (or, inside it, the whole of the
other), by count and combined hash of the messages. Verified links are merged into contigs, which
add what a fragment has beyond its overlap; where messages of two overlapping fragments differ,
their paths are rivals, the link is ambiguous and the path ends there. The number of messages of a
thread is that of its contigs - of threads with rival paths, that of its distinct messages - and
what it states to hold beyond them is a gap, for which it is dropped. A break between contigs
alone is none: TESTDATA.md defines a gap by the stated number.

All steps are aggregates with map-side combination over (thread, file) or (thread, message), so
a thread with a large share of all rows is spread over tasks; only its fragments, one row per
file, are brought together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.operators.threads import numbered
from chatlake.session import materialize

# Other names of the roles.
ROLE_NAMES = {"human": "user", "model": "assistant", "ai": "assistant", "bot": "assistant"}
SPEAKERS = ("user", "assistant", "system", "tool")
#: Timestamps below this are seconds.
SECONDS_BELOW = 100_000_000_000
#: A character that shows: neither white space, control, format nor another character without ink.
VISIBLE = r"[^\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"


def messages(parsed: DataFrame) -> DataFrame:
    """The message rows of threads: speaker in one spelling, ts in milliseconds, whether the text shows anything."""
    role = F.lower(F.regexp_replace("role", r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    for name, meant in ROLE_NAMES.items():
        role = F.when(role == name, meant).otherwise(role)
    ts = F.when(F.col("ts") < SECONDS_BELOW, F.col("ts") * 1000).otherwise(F.col("ts"))
    rows = parsed.where("record_type = 'message' AND conversation_id IS NOT NULL")
    return rows.select("conversation_id", "message_id", "file_id", role.alias("speaker"), ts.alias("ts"), F.coalesce(F.col("text").rlike(VISIBLE), F.lit(False)).alias("visible"), "text")


def fragments(rows: DataFrame) -> DataFrame:
    """One row per (conversation_id, file_id): its range of (ts, message_id), its number of messages, and the fragment that reaches furthest among those before it.

    ``rows`` are distinct (conversation_id, file_id, ts, message_id).
    """
    mark = F.struct("ts", "message_id")
    pieces = rows.groupBy("conversation_id", "file_id").agg(F.min(mark).alias("first"), F.max(mark).alias("last"), F.count("*").alias("n"))
    w = Window.partitionBy("conversation_id").orderBy(F.col("first"), F.col("last").desc(), "file_id")
    ahead = F.max(F.struct("last", "file_id")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumns({"ahead": ahead, "place": F.row_number().over(w)})
    return pieces.select("conversation_id", "file_id", "place", "first", "last", "n", F.col("ahead.last").alias("reach"), F.col("ahead.file_id").alias("ahead_id"))


def overlap_graph(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``shared``, the messages of a verified overlap with the fragment ahead, and ``rival``, whether the two differ where they overlap.

    Both sides of an overlap are counted and their hashes combined in one pass over the rows of the two fragments.
    """
    mark, code = F.struct("ts", "message_id"), F.xxhash64("ts", "message_id")
    links = pieces.where("reach IS NOT NULL AND reach >= first").select("conversation_id", F.col("file_id").alias("of"), "ahead_id", "first", F.least("last", "reach").alias("end"))
    side = F.explode(F.array(F.struct(F.col("of").alias("file_id"), F.lit(True).alias("own")), F.struct(F.col("ahead_id").alias("file_id"), F.lit(False).alias("own"))))
    sides = links.select("conversation_id", "of", "first", "end", side.alias("s")).select("conversation_id", "of", "first", "end", "s.*")
    met = rows.join(sides, ["conversation_id", "file_id"]).where((mark >= F.col("first")) & (mark <= F.col("end")))
    sums = met.groupBy("conversation_id", F.col("of").alias("file_id")).agg(
        F.count_if("own").alias("n_own"), F.count_if(~F.col("own")).alias("n_other"), F.bit_xor(F.when(F.col("own"), code)).alias("h_own"), F.bit_xor(F.when(~F.col("own"), code)).alias("h_other")
    )
    same = F.coalesce((F.col("n_own") == F.col("n_other")) & (F.col("h_own") == F.col("h_other")), F.lit(False))
    judged = sums.select("conversation_id", "file_id", F.when(same, F.col("n_own")).alias("shared"), (~same).alias("rival"))
    return pieces.join(judged, ["conversation_id", "file_id"], "left")


def contigs(rows: DataFrame) -> DataFrame:
    """(conversation_id, file_id, place, contig, follows, added, rival): the fragments of each thread in order, with the contig they merge into.

    A fragment with a verified overlap ``follows`` the one ahead and adds ``added`` messages to its contig; any other begins a new one.
    """
    pieces = materialize(fragments(rows), "fragments")
    graph = overlap_graph(rows, pieces)
    number = F.sum(F.when(F.col("shared").isNotNull(), 0).otherwise(1)).over(Window.partitionBy("conversation_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return graph.select(
        "conversation_id", "file_id", "place", number.cast("int").alias("contig"), F.when(F.col("shared").isNotNull(), F.col("ahead_id")).alias("follows"),
        (F.col("n") - F.coalesce("shared", F.lit(0))).alias("added"), F.coalesce("rival", F.lit(False)).alias("rival"),
    )


def assembled(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages once each, and one row per thread that says whether and why it is dropped.

    Messages: conversation_id, message_id, ts, speaker, visible, files. Copies of a message_id count once (the smallest of
    differing copies); rows with a null message_id count as one message; a null file_id is a file of its own. Threads: counts of
    messages, fragments, contigs and rival overlaps, the largest stated message_count, ``gap``, ``bad``,
    ``first``, ``last`` and ``dropped``. Headers alone make a thread without messages.
    """
    rows = messages(parsed)
    best = F.min(F.struct("ts", "speaker", "visible"))
    found = rows.groupBy("conversation_id", "message_id").agg(best.alias("m"), F.collect_set(F.coalesce("file_id", F.lit(-1))).alias("files"))
    found = materialize(found.select("conversation_id", "message_id", "m.*", "files"), "messages")
    pieces = contigs(found.select("conversation_id", F.explode("files").alias("file_id"), "ts", "message_id"))
    shape = materialize(pieces.groupBy("conversation_id").agg(F.count("*").alias("fragments"), F.max("contig").alias("contigs"), F.count_if("rival").alias("rivals"), F.sum("added").alias("merged")), "threads")
    at = F.struct("ts", "message_id")
    said = F.col("speaker").isin("user", "assistant") & F.col("visible")
    bad = F.col("ts").isNull() | (F.col("ts") <= 0) | F.col("speaker").isNull() | ~F.col("speaker").isin(*SPEAKERS)
    sums = found.groupBy("conversation_id").agg(
        F.sum(bad.cast("int")).alias("bad"),
        F.min_by(F.when(said, F.col("speaker")), F.when(said, at)).alias("first"),
        F.max_by(F.when(said, F.col("speaker")), F.when(said, at)).alias("last"),
    )
    # Rival paths hold some messages twice: there the distinct ones are counted.
    unclear = shape.where("rivals > 0").select("conversation_id")
    counted = found.join(unclear, "conversation_id", "left_semi").groupBy("conversation_id").agg(F.count("*").alias("distinct"))
    stated = parsed.where("conversation_id IS NOT NULL").groupBy("conversation_id").agg(F.max(F.when(F.col("record_type") == "thread", F.col("message_count"))).alias("stated"))
    threads = stated.join(sums, "conversation_id", "left").join(shape, "conversation_id", "left").join(counted, "conversation_id", "left")
    count = F.coalesce("distinct", "merged", F.lit(0))
    threads = threads.select(
        "conversation_id",
        count.alias("messages"),
        F.coalesce("fragments", F.lit(0)).alias("fragments"),
        F.coalesce("contigs", F.lit(0)).alias("contigs"),
        F.coalesce("rivals", F.lit(0)).alias("rivals"),
        "stated",
        F.greatest(F.coalesce(F.col("stated") - count, F.lit(0)), F.lit(0)).alias("gap"),
        F.coalesce("bad", F.lit(0)).alias("bad"),
        "first",
        "last",
    )
    return found, threads.withColumn("dropped", (F.col("gap") > 0) | (F.col("bad") > 0) | ~F.coalesce((F.col("first") == "user") & (F.col("last") == "assistant"), F.lit(False)))


def dropped_threads(parsed: DataFrame) -> DataFrame:
    """(conversation_id) of the threads that are broken, empty or lack a reply."""
    return assembled(parsed)[1].where("dropped").select("conversation_id")


def turns(parsed: DataFrame) -> DataFrame:
    """(conversation_id, turn, message_id, ts, speaker, text) of the threads that are kept, turns from 1 in order of (ts, message_id)."""
    found, threads = assembled(parsed)
    kept = threads.where("NOT dropped").select("conversation_id")
    texts = messages(parsed).groupBy("conversation_id", "message_id").agg(F.min(F.struct("ts", "speaker", "visible", "text"))["text"].alias("text"))
    rows = found.drop("files", "visible").join(kept, "conversation_id", "left_semi").join(texts, ["conversation_id", "message_id"], "left")
    return numbered(rows, ["conversation_id"], [F.col("ts").asc(), F.col("message_id").asc()], "turn").select("conversation_id", "turn", "message_id", "ts", "speaker", "text")
