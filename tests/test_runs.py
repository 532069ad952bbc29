import json
import time
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chatlake import cli, i18n, pipeline
from chatlake.errors import AdapterError, InputError, ValidationError
from chatlake.operators import incremental, split, threads, validate
from chatlake.sinks import files
from chatlake.sources import exports
from chatlake.sources.threads import read_manifest, read_parsed
from chatlake.streaming import exports as streaming


def conversation(cid, n=2, start=1730000000.0, text="hello"):
    mapping = {"root": {"message": None, "parent": None, "children": ["m0"]}}
    for i in range(n):
        mapping[f"m{i}"] = {"parent": f"m{i - 1}" if i else "root", "children": [], "message": {"id": f"{cid}-m{i}", "author": {"role": "user" if i % 2 == 0 else "assistant"}, "content": {"content_type": "text", "parts": [f"{text} {i}"]}, "create_time": start + i}}
    return {"conversation_id": cid, "title": cid, "create_time": start, "mapping": mapping}


def write(path: Path, text: str, bom=False) -> str:
    path.write_text(text, encoding="utf-8-sig" if bom else "utf-8")
    return str(path)


def found(spark, path, kind=None):
    good, bad = exports.read_export(spark, path, kind)
    return good.count(), bad.count()


def test_formats(spark, tmp_path):
    a, b = conversation("a"), conversation("b")
    assert found(spark, write(tmp_path / "1.jsonl", json.dumps(a) + "\n\n" + json.dumps(b) + "\n{broken\n3\n")) == (2, 2)
    assert found(spark, write(tmp_path / "2.json", json.dumps([a, b, 3, "x"]))) == (2, 2)
    assert found(spark, write(tmp_path / "3.json", json.dumps(a, indent=2))) == (1, 0)
    assert found(spark, write(tmp_path / "4.json", "  " + json.dumps({"foo": 1}) + "\n", bom=True)) == (1, 0)
    assert found(spark, write(tmp_path / "5.json", json.dumps([a], indent=1), bom=True)) == (1, 0)
    assert found(spark, write(tmp_path / "6.jsonl", "")) == (0, 0)
    assert found(spark, write(tmp_path / "7.json", "[]")) == (0, 0)
    assert found(spark, write(tmp_path / "8.jsonl", '{"id":"a","id":"b"}\n{"id":"c"}')) == (2, 0)
    with pytest.raises(InputError):
        exports.read_export(spark, str(tmp_path / "missing.jsonl"))


def test_large_arrays_become_lines(tmp_path):
    data = [conversation(str(i)) for i in range(20)] + [5, "x]", None]
    source = write(tmp_path / "a.json", json.dumps(data, indent=1))
    assert exports.split_array_file(source, str(tmp_path / "a.jsonl"), chunk=37) == 23
    assert [json.loads(x) for x in (tmp_path / "a.jsonl").read_text().splitlines()] == data
    with pytest.raises(InputError):
        exports.split_array_file(write(tmp_path / "b.json", '[{"a": 1}, {"b"'), str(tmp_path / "b.jsonl"))


def test_parse_writes_threads_and_manifest(spark, tmp_path):
    source = write(tmp_path / "in.jsonl", "\n".join(json.dumps(conversation(c, n)) for c, n in (("a", 2), ("b", 3))) + "\nbroken\n")
    out = str(tmp_path / "out")
    r = pipeline.parse(spark, "openai", source, out, exported_at="2024-01-01T00:00:00+00:00")
    assert (r.threads, r.messages, r.errors, r.skipped) == (2, 5, 1, 0)
    lines = [json.loads(x) for x in (tmp_path / "out/openai/thread-b/parsed.jsonl").read_text().splitlines()]
    assert lines[0] == {"record_type": "thread", "provider_id": "openai", "conversation_id": "b", "message_count": 3}
    assert [x["message_id"] for x in lines[1:]] == ["b-m0", "b-m1", "b-m2"]
    assert list(lines[1]) == ["record_type", "provider_id", "conversation_id", "message_id", "parent_id", "role", "ts", "content", "text"]
    manifest = json.loads((tmp_path / "out/openai/manifest.json").read_text())
    assert [(t["conversation_id"], t["count"]) for t in manifest["index"]["threads"]] == [("a", 2), ("b", 3)]
    assert validate.validate_manifest(spark, str(tmp_path / "out/openai/manifest.json")).ok
    assert validate.validate_parsed(spark, str(tmp_path / "out/openai/thread-b/parsed.jsonl")).count() == 0
    # Again: all unchanged, the manifest keeps them; then one grows.
    assert pipeline.parse(spark, "openai", source, out).skipped_threads == 2
    assert rows(read_manifest(spark, f"{out}/openai/manifest.json"), "conversation_id", "count") == [("a", 2), ("b", 3)]
    source = write(tmp_path / "in2.jsonl", json.dumps(conversation("a", 4)) + "\n" + json.dumps(conversation("c", 1)))
    r = pipeline.parse(spark, "openai", source, out)
    assert (r.threads, r.skipped_threads) == (2, 0)
    assert rows(read_manifest(spark, f"{out}/openai/manifest.json"), "conversation_id", "count") == [("a", 4), ("b", 3), ("c", 1)]


def test_dry_run_writes_nothing(spark, tmp_path):
    source = write(tmp_path / "in.jsonl", json.dumps(conversation("a")))
    r = pipeline.parse(spark, "openai", source, str(tmp_path / "out"), dry_run=True)
    assert r.threads == 1 and not (tmp_path / "out").exists()


def test_fail_fast(spark, tmp_path):
    with pytest.raises(AdapterError):
        pipeline.parse(spark, "openai", write(tmp_path / "a.jsonl", "x\n" * 4), str(tmp_path), fail_fast=True)
    bad = conversation("a")
    bad["mapping"]["m0"]["message"]["content"]["content_type"] = ""
    with pytest.raises(ValidationError):
        pipeline.parse(spark, "openai", write(tmp_path / "b.jsonl", json.dumps(bad)), str(tmp_path), fail_fast=True)


def test_schema_check_keeps_valid_messages(spark, tmp_path):
    r = pipeline.parse(spark, "openai", write(tmp_path / "a.jsonl", json.dumps(conversation("a", 2)) + "\n" + json.dumps(conversation("n", 1, start=-5.0))), str(tmp_path / "o"), validate_schema=True)
    assert r.threads == 2
    assert len((tmp_path / "o/openai/thread-a/parsed.jsonl").read_text().splitlines()) == 3
    assert len((tmp_path / "o/openai/thread-n/parsed.jsonl").read_text().splitlines()) == 1


def test_chain_to_markdown(spark, tmp_path):
    source = write(tmp_path / "in.jsonl", json.dumps(conversation("a", 3, text="```\ncode")))
    first, second = pipeline.chain(spark, "openai", source, str(tmp_path / "out"), tz="Asia/Tokyo")
    assert first.threads == 1 and second.errors == 0
    text = (tmp_path / "out/export/thread-a.md").read_text()
    assert text.startswith("---\nthread: a\nprovider: openai\nmessages: 3\nmodels: []\nrange: 2024-10-27T03:33:20+00:00 〜 2024-10-27T03:33:22+00:00\n---\n## [user] 2024-10-27 12:33\n- message_id: a-m0\n- parent_id: root\n\n```\ncode 0\n```\n\n")
    spec = split.SplitSpec.parse("count=1", hard=True)
    r = pipeline.export(spark, str(tmp_path / "out/output"), str(tmp_path / "parts"), spec=spec, generated_at="now")
    assert sorted(Path(p).name for p in r.paths) == ["thread-a__part01.md", "thread-a__part02.md", "thread-a__part03.md"]
    assert "message_count: 1\n" in (tmp_path / "parts/thread-a__part02.md").read_text()
    assert pipeline.export(spark, str(tmp_path / "out/output"), str(tmp_path / "none"), preview=True).paths == []
    assert not (tmp_path / "none").exists()


def test_unwritable_thread_does_not_stop_others(spark, tmp_path):
    (tmp_path / "thread-a.md").mkdir()
    docs = spark.createDataFrame([("thread-a.md", "x"), ("thread-b.md", "y")], "file_name string, markdown string")
    got = rows(files.write_documents(docs, str(tmp_path)), "path", (F.col("error").isNotNull()).alias("failed"))
    assert [(Path(p).name, e) for p, e in got] == [("thread-a.md", True), ("thread-b.md", False)]
    assert not list(tmp_path.glob(".*tmp"))


def test_read_parsed_skips_bad_lines(spark, tmp_path):
    write(tmp_path / "parsed.jsonl", '{"record_type":"thread","provider_id":"p","conversation_id":"c","message_count":1}\n\nnonsense\n{"record_type":"thread","provider_id":"p","conversation_id":"second"}\n{"record_type":"message","conversation_id":"c","message_id":"m","meta":null}\n{"record_type":"other"}\n')
    headers, messages = read_parsed(spark, str(tmp_path))
    assert rows(headers, "conversation_id") == [("c",)] and messages.count() == 1
    assert [Path(p).name for p in exports.discover(str(tmp_path))] == ["parsed.jsonl"]


def test_missing_or_broken_manifest_is_empty(spark, tmp_path):
    assert read_manifest(spark, str(tmp_path / "no.json")).count() == 0
    assert read_manifest(spark, write(tmp_path / "m.json", "{broken")).count() == 0


# Splitting.


def parts_of(sizes, spec):
    packer = split.Packer(spec, len(sizes))
    return [packer.add(s) for s in sizes]


def counts(parts):
    return [parts.count(p) for p in sorted(set(parts))]


def test_packing_examples():
    assert counts(parts_of([1] * 35, split.SplitSpec.parse("count=10"))) == [10, 25]
    assert counts(parts_of([1] * 35, split.SplitSpec.parse("count=10", tiny_tail=0))) == [10, 10, 10, 5]
    assert counts(parts_of([1] * 35, split.SplitSpec.parse("count=10", hard=True))) == [10, 10, 10, 5]
    assert counts(parts_of([1] * 22, split.SplitSpec.parse("count=1"))) == [22]
    assert counts(parts_of([1000] * 60, split.SplitSpec.parse("size=4096"))) == [3] * 12 + [24]


@pytest.mark.parametrize("spec", [split.SplitSpec.parse(s, **o) for s, o in (("count=3", {"tiny_tail": 1}), ("size=4K", {"tiny_tail": 2}), ("size=4K", {"hard": True}), ("auto", {}), ("size=3000", {"soft_overflow": 0.5, "tiny_tail": 0}))])
def test_expression_agrees_with_stream(spark, spec):
    m = spark.createDataFrame([("p", f"c{i % 5}", f"m{i:03}", None, "user", i, ("text", ["x" * (i * 37 % 900)]), "x" * (i * 37 % 900), None) for i in range(120)], "provider_id string, conversation_id string, message_id string, parent_id string, role string, ts bigint, content struct<content_type:string,parts:array<string>>, text string, meta map<string,string>")
    assert rows(split.assign_parts(m, spec), "message_id", "part_index") == rows(split.assign_parts_in_row(m, spec), "message_id", "part_index")
    assert split.assign_parts(m.limit(0), spec).count() == 0


def thread_of(spark, n, provider="p"):
    """A thread of ``n`` messages of varied sizes, in no order, some without a time."""
    m = spark.range(n).repartition(7)
    text = F.repeat(F.lit("x"), (F.col("id") * 37 % 900).cast("int"))
    return m.select(F.lit(provider).cast("string").alias("provider_id"), F.lit("c").alias("conversation_id"), F.format_string("m%07d", "id").alias("message_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("user").alias("role"), F.when(F.col("id") % 97 > 0, F.col("id")).alias("ts"), F.struct(F.lit("text").alias("content_type"), F.array(text).alias("parts")).alias("content"), text.alias("text"), F.lit(None).cast("map<string,string>").alias("meta"))


def check_parts_in_row(messages, spec):
    got = sorted(split.assign_parts_in_row(messages, spec).collect(), key=lambda r: (r.ts is None, r.ts, r.message_id))
    assert len(got) == messages.count()
    assert [r.part_index for r in got] == parts_of([r.bytes for r in got], spec)


def test_fold_of_a_long_thread_takes_linear_time(spark):
    m = thread_of(spark, 60_000)
    began = time.monotonic()
    check_parts_in_row(m, split.SplitSpec.parse("size=4K", tiny_tail=2))
    assert time.monotonic() - began < 30  # a fold in quadratic time takes minutes


@pytest.mark.parametrize("n", [1, 256, 257, 1537])
def test_fold_across_chunks(spark, n):
    for s, o in (("size=4K", {"tiny_tail": 2}), ("size=4096", {"hard": True}), ("count=300", {}), ("auto", {})):
        check_parts_in_row(thread_of(spark, n), split.SplitSpec.parse(s, **o))
    # Threads without a provider are threads, too.
    check_parts_in_row(thread_of(spark, n, None), split.SplitSpec.parse("count=3"))


def test_split_specs():
    assert split.SplitSpec.parse("auto").count_limit == 1500 and split.SplitSpec.parse(None).mode is None
    for bad in ("weird", "count=x", "size=", "size=x"):
        with pytest.raises(ValueError):
            split.SplitSpec.parse(bad)


# Incremental.


def test_decisions(spark):
    index = spark.createDataFrame([("p", c, n, 1, t, []) for c, n, t in (("new", 1, 1), ("same", 2, 5), ("more", 3, 5), ("back", 2, 4), ("null", 2, None))], "provider_id string, conversation_id string, message_count bigint, ts_min bigint, ts_max bigint, models array<string>")
    old = spark.createDataFrame([("p", c, "x", 2, 1, 5) for c in ("same", "more", "back", "null", "kept")] + [("p", "same", "y", 9, 1, 5)], "provider string, conversation_id string, path string, count bigint, ts_min bigint, ts_max bigint")
    assert rows(incremental.classify(index, old), "conversation_id", "decision") == [("back", "SKIP"), ("more", "REPLACE"), ("new", "NEW"), ("null", "SKIP"), ("same", "SKIP")]
    assert rows(incremental.classify(index, old, "time"), "conversation_id", "decision") == [("back", "WARN"), ("more", "REPLACE"), ("new", "NEW"), ("null", "REPLACE"), ("same", "SKIP")]
    merged = incremental.merge_manifest(incremental.classify(index, old), old)
    assert {r[0] for r in rows(merged, "conversation_id")} == {"new", "more", "same", "back", "null", "kept"}


# Validation.


def test_reasons_and_fail_fast(spark):
    m = spark.createDataFrame([("c", "m", "user", 1, ("text", ["a"]), "a"), ("", None, "", None, ("", [None]), None), ("c", "m", "user", 1, None, "")], "conversation_id string, message_id string, role string, ts bigint, content struct<content_type:string,parts:array<string>>, text string")
    assert [r.reasons for r in validate.with_reasons(m).collect()] == [[], [x for x in validate.REASONS if x != "content"], ["content"]]
    with pytest.raises(Exception, match="missing or invalid"):
        validate.fail_fast(m).collect()
    assert validate.fail_fast(m.limit(1)).count() == 1


def test_message_schema(spark):
    good = {"record_type": "message", "provider_id": "p", "conversation_id": "c", "message_id": "m", "role": "user", "ts": 1, "content": {"content_type": "text", "parts": ["a"]}, "text": "", "more": 1}
    cases = [good, {**good, "ts": -1}, {**good, "ts": 1.5}, {**good, "parent_id": None}, {**good, "record_type": "thread"}, {**good, "content": {"content_type": "", "parts": [1]}}, {k: v for k, v in good.items() if k != "role"}, {**good, "meta": []}, [1]]
    df = spark.createDataFrame([("f", i, json.dumps(c)) for i, c in enumerate(cases)] + [("f", 9, "{")], "path string, line_no bigint, raw string").withColumn("v", F.try_parse_json("raw"))
    got = validate.violations(df, validate.schema_file("message"))
    assert rows(got, "line_no", "field_path") == [(1, "ts"), (2, "ts"), (3, "parent_id"), (4, "record_type"), (5, "content.content_type"), (5, "content.parts"), (6, "<root>"), (7, "meta"), (8, "<root>"), (9, "<root>")]
    assert validate.first_violation(got).count() == 9


def test_summary():
    with pytest.raises(ValidationError, match="line 3"):
        validate.Summary("f", False, [{"line_no": 3, "field_path": "ts", "message": "bad"}]).raise_if_failed()
    validate.Summary("f", True).raise_if_failed()


# Command line, texts, streams.


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda **_: spark)
    source = write(tmp_path / "in.jsonl", json.dumps(conversation("a")))
    out = str(tmp_path / "out")
    assert cli.run(["parse", "--input", source, "--outdir", out]) == 0
    assert cli.run(["export", "--input", out, "--outdir", str(tmp_path / "md"), "--tz", "Nowhere/Land", "--split", "auto"]) == 0
    assert (tmp_path / "md/thread-a.md").exists()
    assert cli.run(["--locale", "ja", "chain", "--input", source, "--outdir", str(tmp_path / "x")]) == 0
    assert cli.run(["parse", "--input", str(tmp_path / "missing")]) == 2
    assert cli.run(["chain", "--parsed-root", str(tmp_path / "missing")]) == 4
    assert cli.run(["export", "--input", out, "--outdir", out, "--split", "weird"]) == 1
    assert cli.run(["parse", "--provider", "nobody", "--input", source]) == 99
    assert cli.run(["viewer"]) == 0
    i18n.set_locale("en")


def test_texts(monkeypatch):
    assert i18n.normalize("ja_JP") == "ja" and i18n.normalize("xx") == "en"
    monkeypatch.setenv(i18n.LOCALE_VARIABLE, "ja-JP")
    assert i18n.resolve() == "ja" and i18n.resolve("en") == "en"
    assert i18n.t("viewer", "ja") == i18n.CATALOGS["en"]["viewer"] and i18n.t("nothing") == "nothing"
    assert i18n.t("parsed", "en") == i18n.CATALOGS["en"]["parsed"]


def test_stream_of_snapshots(spark, tmp_path):
    drop, table, check = tmp_path / "drop", str(tmp_path / "table"), str(tmp_path / "check")
    drop.mkdir()
    for k, data in enumerate(([conversation("a", 2), conversation("b", 1)], [conversation("a", 3), conversation("b", 1)])):
        write(drop / f"{k}.jsonl", "\n".join(map(json.dumps, data)))
        streaming.run(spark, str(drop), table, check).awaitTermination(120)
    assert rows(threads.thread_index(streaming.current(spark, table).drop("batch")), "conversation_id", "message_count") == [("a", 3), ("b", 1)]
    assert rows(spark.read.parquet(table).groupBy("batch").count().orderBy("batch"), "count") == [(3,), (3,)]


def test_folders_of_mixed_files(spark, tmp_path):
    """Each file is read by its own kind: none of a line, array and object file loses a row to another."""
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"id": "a1"}\n\n{"id": "a2"}\nbroken\n')
    (folder / "b.json").write_text('[\n  {"id": "b1"},\n  {"id": "b2", "x": [1, {"y": "]"}]},\n  7\n]\n')
    (folder / "c.json").write_text('{\n  "id": "c1"\n}\n')
    (folder / "d.json").write_text("\ufeff  [{\"id\": \"d1\"}]")
    (folder / "e.json").write_text("")
    (folder / "_SUCCESS").write_text("x")
    (folder / "f.jsonl").write_text('{"id": "f1", "t": "' + "z" * 100_000 + '"}\n{"id": "f2"}\n')
    good, bad = exports.read_export(spark, str(folder))
    ids = sorted(r[0] for r in good.selectExpr("variant_get(v, '$.id', 'string')").collect())
    assert ids == ["a1", "a2", "b1", "b2", "c1", "d1", "f1", "f2"]
    assert sorted((r.source.rsplit("/", 1)[1], r.raw) for r in bad.collect()) == [("a.jsonl", "broken"), ("b.json", None)]


def test_large_arrays_are_streamed(spark, tmp_path, monkeypatch):
    import json

    records = [{"id": f"r{i}", "text": "ä[]{}\"\\ " * (i % 50)} for i in range(2000)]
    (tmp_path / "large.json").write_text(json.dumps(records, ensure_ascii=False, indent=1), "utf-8")
    monkeypatch.setattr(exports, "WHOLE_BYTES", 1000)
    good, bad = exports.read_export(spark, str(tmp_path / "large.json"))
    got = {r[0]: r[1] for r in good.selectExpr("variant_get(v, '$.id', 'string')", "variant_get(v, '$.text', 'string')").collect()}
    assert got == {r["id"]: r["text"] for r in records} and bad.count() == 0
    assert {r.source.rsplit("/", 1)[1] for r in good.select("source").distinct().collect()} == {"large.json"}


def test_progress_and_totals_are_logged(spark, tmp_path, monkeypatch, caplog):
    import logging

    monkeypatch.setattr(pipeline, "PROGRESS", 2)
    source = write(tmp_path / "in.jsonl", "\n".join(json.dumps(conversation(c)) for c in "abcde") + "\nbroken\n")
    with caplog.at_level(logging.INFO, logger="chatlake"):
        first, second = pipeline.chain(spark, "openai", source, str(tmp_path / "out"))
    said = [r.getMessage() for r in caplog.records]
    assert "2 threads written" in said and "4 threads written" in said and "4 files written" in said
    assert "chain: 5 threads parsed, 0 skipped, 1 records in error; 5 files written, 0 failed" in said
    assert (first.threads, len(second.paths)) == (5, 5)


def test_the_schema_counts_what_it_turns_away(spark, tmp_path):
    """A time before 1970 passes the rules, not the schema."""
    source = write(tmp_path / "in.jsonl", json.dumps(conversation("a", 2)) + "\n" + json.dumps(conversation("b", 1, start=-5.0)))
    assert pipeline.parse(spark, "openai", source, str(tmp_path / "one")).skipped_messages == 0
    assert pipeline.parse(spark, "openai", source, str(tmp_path / "two"), validate_schema=True).skipped_messages == 1
