import json
from datetime import datetime

from conftest import rows

from chatlake.operators import drift

RAW = "file_id bigint, line_no int, record_kind string, raw string, change string"
MANIFEST = "file_id bigint, stream_id string, exported_at timestamp, field string"


def tables(spark, files, streams=None):
    data = []
    for f, lines in files.items():
        data += [(f, i, kind, x if isinstance(x, str) or x is None else json.dumps(x), "clash") for i, (kind, x) in enumerate(lines)]
    manifest = [(f, (streams or {}).get(f, "s"), datetime(2024, 1, f), "clash") for f in files]
    return spark.createDataFrame(data, RAW), spark.createDataFrame(manifest, MANIFEST)


def test_changes_of_each_kind(spark):
    raw, manifest = tables(
        spark,
        {
            1: [("node", {"id": "a", "m": {"role": "user", "w": 1, "gone": {"x": 1}, "tags": ["t"]}}), ("node", {"id": "b", "m": {"role": "tool", "w": None}}), ("node", "{broken"), ("node", None)],
            2: [("node", {"id": "a", "m": {"kind": "user", "w": "1", "new": {"y": [1]}, "tags": "t"}}), ("node", {"id": "b", "m": {"kind": "tool", "w": None}}), ("node", {"id": "b", "m": {"kind": "tool", "w": None}})],
        },
    )
    want = [(2, "node", "added", "m.new", ""), (2, "node", "removed", "m.gone", ""), (2, "node", "renamed", "m.role", "m.kind"), (2, "node", "type_changed", "m.tags", ""), (2, "node", "type_changed", "m.w", "")]
    assert rows(drift.schema_changes(raw, manifest)) == sorted(want, key=repr)


def test_renamed_objects_hide_what_is_below(spark):
    raw, manifest = tables(spark, {1: [("node", {"id": "a", "content": {"t": 1, "p": {"q": 2}}})], 2: [("node", {"id": "a", "body": {"t": 1.0, "p": {"q": 2}}})]})
    assert rows(drift.schema_changes(raw, manifest)) == [(2, "node", "renamed", "content", "body")]


def test_no_rename_without_equal_values(spark):
    raw, manifest = tables(spark, {1: [("node", {"id": "a", "x": 1}), ("node", {"id": "b", "x": 1})], 2: [("node", {"id": "a", "y": 1}), ("node", {"id": "b", "y": 2})]})
    assert rows(drift.schema_changes(raw, manifest)) == [(2, "node", "added", "y", ""), (2, "node", "removed", "x", "")]


def test_manifest_records_and_other_streams(spark):
    raw, manifest = tables(spark, {1: [("manifest", {"v": "1"})], 2: [("manifest", {"version": "1"})], 3: [("manifest", {"other": 1})]}, {3: "t"})
    assert rows(drift.schema_changes(raw, manifest)) == [(2, "manifest", "renamed", "v", "version")]


def test_arrays_compare_by_their_element_types(spark):
    raw, manifest = tables(spark, {1: [("node", {"id": "a", "x": [], "y": [1], "z": [[1], "a"]})], 2: [("node", {"id": "a", "x": [1], "y": [2, None], "z": ["b", [2]]})]})
    assert rows(drift.schema_changes(raw, manifest)) == [(2, "node", "type_changed", "x", "")]


def test_rescue_keeps_what_does_not_fit_and_replay_promotes(spark):
    target = drift.Target({"role": ("m.role", "string"), "weight": ("m.weight", "double"), "done": ("m.done", "boolean"), "parts": ("m.parts", "strings")})
    raw, _ = tables(spark, {1: [("node", {"m": {"role": "user", "weight": "1.5", "done": "true", "parts": ["a"], "odd": {"k": [1]}}}), ("node", {"m": {"kind": "ai", "weight": {"v": 2}, "done": 3, "blocks": "a\nb"}}), ("node", "[1]"), ("node", "nonsense")]})
    got = drift.rescue(raw, target).collect()
    assert (got[0].role, got[0].weight, got[0].done, got[0].parts, got[0].rescued) == ("user", 1.5, True, ["a"], {"m.odd.k": "[1]"})
    assert (got[1].role, got[1].weight) == (None, None)
    assert got[1].rescued == {"m.kind": '"ai"', "m.weight.v": "2", "m.done": "3", "m.blocks": '"a\\nb"'}
    assert [r.valid for r in got] == [True, True, False, False]
    again = drift.replay(drift.rescue(raw, target), {"role": ("m.kind",), "parts": ("m.blocks",), "weight": ("m.weight.v",)}, target).collect()
    assert (again[1].role, again[1].parts, again[1].weight, again[1].rescued) == ("ai", ["a", "b"], 2.0, {"m.done": "3"})


def test_unified_table(spark):
    raw, manifest = tables(spark, {1: [("node", {"id": "a", "message": {"author": {"role": "user"}}})], 2: [("node", {"id": "a", "message": {"sender": {"role": "user"}}})]})
    assert rows(drift.unified(raw, manifest), "file_id", "role") == [(1, "user"), (2, "user")]


def test_empty(spark):
    raw, manifest = tables(spark, {1: [("node", {"id": 1})]})
    assert drift.schema_changes(raw.limit(0), manifest.limit(0)).count() == 0


# The whole report against a plain restatement of its definition, on the sample table.


def types(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, list):
        return "array", frozenset(types(v) for v in value if v is not None)
    return "object" if isinstance(value, dict) else "string"


def flat(obj, prefix=""):
    out = {}
    for k, v in obj.items():
        out[prefix + k] = v
        if isinstance(v, dict):
            out |= flat(v, f"{prefix}{k}.")
    return out


def restated(raw, manifest):
    fields, records = {}, {}
    for file_id, kind, text in raw:
        try:
            record = json.loads(text)
        except (ValueError, TypeError):
            continue
        if isinstance(record, dict):
            f = flat(record)
            for p, v in f.items():
                fields.setdefault((file_id, kind), {}).setdefault(p, set()).update({types(v)} - {None})
            records.setdefault((file_id, kind), []).append(("" if kind == "manifest" else record.get("id"), f))
    out = set()
    for (s1, _, old), (s2, _, new) in zip(manifest, manifest[1:]):
        for kind in ("node", "manifest") if s1 == s2 else ():
            a, b = fields.get((old, kind), {}), fields.get((new, kind), {})
            report = [("type_changed", p, "") for p in a.keys() & b.keys() if a[p] and b[p] and a[p] != b[p]]
            moved = set()
            for x in a.keys() - b.keys():
                for y in b.keys() - a.keys():
                    pairs = [(f[x], g[y]) for i, f in records.get((old, kind), []) for j, g in records.get((new, kind), []) if i is not None and i == j and f.get(x) is not None and g.get(y) is not None]
                    if pairs and all(u == v and types(u) == types(v) for u, v in pairs):
                        moved.add((x, y))
            report += [("renamed", x, y) for x, y in moved]
            report += [("removed", x, "") for x in a.keys() - b.keys() - {x for x, _ in moved}] + [("added", y, "") for y in b.keys() - a.keys() - {y for _, y in moved}]
            named = {x for _, x, _ in report} | {y for _, _, y in report if y}
            covered = lambda p: any(p[:k] in named for k, c in enumerate(p) if c == ".")
            out |= {(new, kind, c, x, y) for c, x, y in report if not covered(x) and not (y and covered(y))}
    return out


def test_report_of_the_sample_table(spark):
    from pathlib import Path

    import pytest

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables here")
    raw, manifest = spark.read.parquet(f"{folder}/raw_records.parquet"), spark.read.parquet(f"{folder}/manifest.parquet")
    want = restated([tuple(r) for r in raw.select("file_id", "record_kind", "raw").collect()], sorted((r.stream_id, r.exported_at, r.file_id) for r in manifest.collect()))
    got = rows(drift.schema_changes(raw, manifest))
    assert len(want) > 20 and set(got) == want and len(got) == len(want)


def test_no_rename_is_dropped(spark):
    """More names than a thousand, and an object that moves into itself."""
    path = drift.RECORDS.columns["content_type"][0]
    many = [("renamed", path, f"n{i}") for i in range(1500)] + [("renamed", "n1499", "o.p"), ("renamed", "o", "o.q")]
    names = drift.renames(spark.createDataFrame(many, "change string, field string, new_field string"))["content_type"]
    assert {f"n{i}" for i in range(1500)} | {"o.p", "o.q.p"} <= set(names)


def test_the_report_reads_typed_and_rescued_fields(spark):
    """Fields that fill typed columns are compared like rescued ones, keys that hold dots and long odd texts included."""
    raw, manifest = tables(spark, {1: [("node", {"id": "a", "message": {"author": {"role": "user"}, "content": {"parts": ["x"]}}, "a.b": 1, "a": {"b": 2}})], 2: [("node", {"id": "a", "message": {"speaker": {"role": "user"}, "content": {"parts": ["x", 1]}}, "a.b": 1, "a": {"b": 2}, "message.id": "y" * 100_000})]})
    assert rows(drift.schema_changes(raw, manifest)) == [(2, "node", "added", "message.id", ""), (2, "node", "renamed", "message.author", "message.speaker"), (2, "node", "type_changed", "message.content.parts", "")]
    shape = drift.rescue(raw).first().shape
    assert ["message.content", "object"] in json.loads(shape) and ["message.author.role", "string"] in json.loads(shape)
