"""The three runs: parse (exports to threads), export (threads to Markdown), chain (both)."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.operators import incremental, render, split, threads, validate
from chatlake.operators.normalize import normalizer, policy_defaults
from chatlake.sinks import files
from chatlake.sources import exports
from chatlake.sources.threads import read_manifest, read_parsed

log = logging.getLogger("chatlake")
#: Written files between two lines of progress in the log.
PROGRESS = 100


@dataclass
class Result:
    """Totals of a run; ``samples`` are the first errors."""

    threads: int = 0
    messages: int = 0
    errors: int = 0
    skipped_threads: int = 0
    skipped_messages: int = 0
    samples: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)

    @property
    def skipped(self) -> int:
        return self.skipped_threads + self.skipped_messages


def _followed(rows: Iterator, what: str) -> Iterator:
    """``rows`` once more, with a line in the log every ``PROGRESS`` of them."""
    for n, r in enumerate(rows, 1):
        yield r
        if n % PROGRESS == 0:
            log.info("%d %s", n, what)


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def parse(spark: SparkSession, provider: str, path: str, outdir: str, *, dry_run: bool = False, fail_fast: bool = False, validate_schema: bool = False, max_errors: int = 3, decide_by: str = "count", exported_at: str | None = None, tables: bool = False) -> Result:
    """Read exports at ``path`` and write one parsed.jsonl per thread and the manifest under ``outdir/provider``.

    A dry run writes nothing, folders included. Unchanged threads are skipped and stay in the manifest.
    """
    conversations, bad = exports.read_export(spark, path)
    samples = [f"{r['source']}: {(r['raw'] or '')[:200]}" for r in threads.error_samples(bad).collect()]
    if fail_fast:
        threads.check_errors(bad, max_errors)
    checked = validate.with_reasons(normalizer(provider)(conversations).withColumn("provider_id", F.lit(provider))).persist()
    try:
        index = threads.thread_index(checked)
        old = read_manifest(spark, f"{outdir}/{provider}/manifest.json")
        classified = incremental.classify(index, old, decide_by).persist()
        totals = classified.agg(F.count("*").alias("n"), F.sum((F.col("decision") == "SKIP").cast("int")).alias("s"), F.sum(F.when(F.col("decision") != "SKIP", F.col("message_count"))).alias("m")).first()
        valid = checked
        if validate_schema:
            record = F.to_variant_object(F.struct(F.lit("message").alias("record_type"), "provider_id", "conversation_id", "message_id", "role", "ts", "content", "text"))
            rows = checked.select(F.col("conversation_id").alias("path"), F.col("message_id").alias("line_no"), record.alias("v"))
            found = validate.violations(rows, validate.schema_file("message")).select(F.col("path").alias("conversation_id"), F.col("line_no").alias("message_id")).distinct()
            valid = checked.join(found, ["conversation_id", "message_id"], "left_anti")
        fresh = classified.where("decision <> 'SKIP'")
        valid = valid.where("valid").drop("reasons", "valid")
        # Messages that the rules or, if asked for, the schema turn away.
        wrong = checked.count() - valid.count() if validate_schema else checked.where("NOT valid").count()
        if fail_fast and wrong:
            raise validate.ValidationError(f"{wrong} messages are invalid")
        result = Result(totals["n"] - (totals["s"] or 0), totals["m"] or 0, bad.count(), totals["s"] or 0, wrong, samples)
        if not dry_run:
            written = files.write_parsed(valid.join(fresh.select("conversation_id"), "conversation_id", "left_semi"), fresh, outdir)
            for r in _followed(written.toLocalIterator(), "threads written"):
                result.paths.append(r["path"])
                if r["error"]:
                    result.errors += 1
                    result.samples = [*result.samples, f"{r['path']}: {r['error']}"][:5]
            if tables:
                files.write_messages(valid, f"{outdir}/tables/messages")
            merged = incremental.merge_manifest(classified, old)
            files.write_manifest(f"{outdir}/{provider}/manifest.json", files.manifest_json(merged, provider, exported_at or now(), policy_defaults(provider)))
        return result
    finally:
        checked.unpersist()


def write_markdown(messages: DataFrame, outdir: str, spec: split.SplitSpec, tz: str, formatting: str, generated_at: str) -> DataFrame:
    """Write the Markdown of all threads; gives (path, error) of each file."""
    if spec.mode:
        return files.write_documents(split.part_documents(messages, spec, generated_at, tz, formatting), outdir)
    chunks = render.thread_chunks(messages, tz, formatting)
    return files.write_chunks(chunks.withColumn("file_name", split.file_name(F.col("conversation_id"), F.lit(1), F.lit(1))), outdir)


def export(spark: SparkSession, parsed: str, outdir: str, *, tz: str = "UTC", formatting: str = "light", spec: split.SplitSpec | None = None, preview: bool = False, generated_at: str | None = None) -> Result:
    """Write Markdown of the parsed.jsonl files at or under ``parsed``."""
    spec = spec or split.SplitSpec()
    headers, messages = read_parsed(spark, parsed)
    if preview:
        for r in render.preview(messages, spec.size_limit or 4 * 1024**2, tz, formatting).toLocalIterator():
            log.info("[preview] %s: %d bytes, %d messages, about %d parts", r["conversation_id"], r["bytes"], r["messages"], r["parts"])
        return Result()
    written = write_markdown(messages, outdir, spec, tz, formatting, generated_at or now())
    result = Result()
    for r in _followed(written.toLocalIterator(), "files written"):
        if r["error"]:
            result.errors += 1
            result.samples = [*result.samples, r["error"]][:5]
        else:
            result.paths.append(r["path"])
    result.threads = headers.count()
    return result


def chain(spark: SparkSession, provider: str, path: str, outdir: str, *, parsed_root: str | None = None, export_outdir: str | None = None, dry_run: bool = False, tz: str = "UTC", formatting: str = "light", spec: split.SplitSpec | None = None, fail_fast: bool = False, **options) -> tuple[Result, Result]:
    """Parse, then export what was parsed; with ``parsed_root`` only export."""
    first = Result()
    root = parsed_root
    if root is None:
        root = f"{outdir}/output"
        first = parse(spark, provider, path, root, dry_run=dry_run, fail_fast=fail_fast, **options)
    if not exports.discover(root):
        log.warning("no threads under %s", root)
        return first, Result()
    second = export(spark, root, export_outdir or f"{outdir}/export", tz=tz, formatting=formatting, spec=spec)
    log.info("chain: %d threads parsed, %d skipped, %d records in error; %d files written, %d failed", first.threads, first.skipped_threads, first.errors, len(second.paths), second.errors)
    if fail_fast and second.errors:
        raise files.WriteError(second.samples[0])
    return first, second
