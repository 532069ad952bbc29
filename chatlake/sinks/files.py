"""Writers. Tables are Parquet; the contract forms are one JSON Lines file and one Markdown file per thread or part."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.errors import WriteError
from chatlake.functions.text import sanitize_filename

#: Buckets of the canonical message table, so that a thread is found without a folder for each.
BUCKETS = 64


def write_messages(messages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The canonical table: Parquet by provider and bucket of the thread, sorted by thread and time."""
    rows = messages.withColumn("bucket", F.pmod(F.xxhash64("conversation_id"), F.lit(BUCKETS)).cast("int"))
    rows.repartition("provider_id", "bucket").sortWithinPartitions("conversation_id", "ts", "message_id").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("provider_id", "bucket").parquet(path)


def json_line(*columns: str | Column) -> Column:
    """A row as JSON with nulls kept and non-ASCII escaped."""
    return F.to_json(F.struct(*columns), {"writeNonAsciiCharacterAsCodePoint": "true", "ignoreNullFields": "false"})


def parsed_lines(messages: DataFrame, index: DataFrame) -> DataFrame:
    """(provider_id, conversation_id, kind, ts, message_id, line): header and message lines of parsed.jsonl."""
    head = index.select("provider_id", "conversation_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("ts"), F.lit(None).cast("string").alias("message_id"), json_line(F.lit("thread").alias("record_type"), "provider_id", "conversation_id", "message_count").alias("line"))
    body = messages.select("provider_id", "conversation_id", F.lit(1).alias("kind"), "ts", "message_id", json_line(F.lit("message").alias("record_type"), "provider_id", "conversation_id", "message_id", "parent_id", "role", "ts", "content", "text").alias("line"))
    return head.unionByName(body)


def _replace(path: Path, write) -> None:
    """Write beside ``path`` and move into place; nothing half written stays."""
    path.parent.mkdir(parents=True, exist_ok=True)
    tmp = path.with_name(f".{path.name}.{os.getpid()}.tmp")
    try:
        with tmp.open("w", encoding="utf-8", newline="\n") as f:
            write(f)
        os.replace(tmp, path)
    except OSError as e:
        tmp.unlink(missing_ok=True)
        raise WriteError(f"cannot write {path}: {e}") from e


def write_parsed(messages: DataFrame, index: DataFrame, outdir: str) -> DataFrame:
    """One ``<outdir>/<provider>/thread-<id>/parsed.jsonl`` per thread, on a file system all executors share.

    Lines are sorted within their partition and streamed, so a thread of any length passes through one open file. Gives
    (path, lines, error) of each file; a file that cannot be written is reported, others go on.
    """
    lines = parsed_lines(messages, index).withColumn("folder", F.concat("provider_id", F.lit("/thread-"), sanitize_filename(F.col("conversation_id"))))
    lines = lines.repartition("folder").sortWithinPartitions("folder", "kind", "ts", "message_id").select("folder", "line")
    return lines.mapInPandas(_grouped_writer(outdir, "parsed.jsonl"), "path string, lines bigint, error string")


def _grouped_writer(outdir: str, name: str | None, end: str = "\n"):
    """Writes rows (folder, line), sorted by folder: the file ``name`` of each folder, or without a name the file the folder names."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {"folder": None, "file": None, "tmp": None, "n": 0, "error": None}

        def target_of(folder: str) -> Path:
            return Path(outdir) / folder / name if name else Path(outdir) / folder

        def close():
            if state["folder"] is None:
                return None
            path = target_of(state["folder"])
            if state["file"]:
                state["file"].close()
                if not state["error"]:
                    os.replace(state["tmp"], path)
                else:
                    Path(state["tmp"]).unlink(missing_ok=True)
            return (str(path), state["n"], state["error"])

        for f in frames:
            done = []
            for folder, line in zip(f["folder"], f["line"]):
                if folder != state["folder"]:
                    if (x := close()) is not None:
                        done.append(x)
                    state.update(folder=folder, n=0, error=None, file=None)
                    try:
                        target = target_of(folder)
                        target.parent.mkdir(parents=True, exist_ok=True)
                        state["tmp"] = str(target.with_name(f".{target.name}.{os.getpid()}.tmp"))
                        state["file"] = open(state["tmp"], "w", encoding="utf-8", newline="\n")
                    except OSError as e:
                        state["error"] = str(e)
                if state["file"] and not state["error"]:
                    try:
                        state["file"].write(line + end)
                        state["n"] += 1
                    except OSError as e:
                        state["error"] = str(e)
            yield pd.DataFrame(done, columns=["path", "lines", "error"])
        if (x := close()) is not None:
            yield pd.DataFrame([x], columns=["path", "lines", "error"])

    return run


def write_chunks(chunks: DataFrame, root: str) -> DataFrame:
    """One file per ``file_name`` of chunks (file_name, position, chunk), streamed in order; gives (path, lines, error) with the number of chunks."""
    rows = chunks.select(F.col("file_name").alias("folder"), "position", F.col("chunk").alias("line")).repartition("folder").sortWithinPartitions("folder", "position").select("folder", "line")
    return rows.mapInPandas(_grouped_writer(root, None, ""), "path string, lines bigint, error string")


def write_documents(documents: DataFrame, root: str, file_name: str = "file_name", text: str = "markdown") -> DataFrame:
    """One file per row under ``root``; gives (path, bytes, error). A row that cannot be written is reported, others go on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for n, t in zip(f["name"], f["text"]):
                path = Path(root) / n
                try:
                    _replace(path, lambda g, t=t: g.write(t))
                    out.append((str(path), len(t.encode()), None))
                except WriteError as e:
                    out.append((str(path), 0, str(e)))
            yield pd.DataFrame(out, columns=["path", "bytes", "error"])

    return documents.select(F.col(file_name).alias("name"), F.col(text).alias("text")).mapInPandas(run, "path string, bytes bigint, error string")


def manifest_json(entries: DataFrame, provider: str, exported_at: str, policy: dict, schema_version: str = "1.3") -> str:
    """The manifest as JSON text, ASCII, two spaces deep; one entry per thread reaches the driver, without its messages."""
    threads = [r.asDict() for r in entries.select("conversation_id", "path", "count", "ts_min", "ts_max").orderBy("conversation_id").toLocalIterator()]
    return json.dumps({"schema_version": schema_version, "provider": provider, "policy": policy, "exported_at": exported_at, "index": {"threads": threads}}, indent=2)


def write_manifest(path: str, text: str) -> None:
    _replace(Path(path), lambda f: f.write(text))
