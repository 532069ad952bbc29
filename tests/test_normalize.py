import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chatlake.errors import AdapterError
from chatlake.operators import normalize, threads, tree


def conversations(spark, *values, source="/exports/dump-7.jsonl"):
    df = spark.createDataFrame([(source, i, json.dumps(v)) for i, v in enumerate(values)], "source string, line_no bigint, raw string")
    return df.select("source", "line_no", F.try_parse_json("raw").alias("v"))


def node(message, parent=None, children=(), **more):
    return {"id": "x", "message": message, "parent": parent, "children": list(children), **more}


def test_minimal_conversation(spark):
    v = {"conversation_id": "c1", "title": "t", "mapping": {"root": node(None, None, ["m1"]), "m1": node({"id": "m1", "author": {"role": "user"}, "content": {"content_type": "text", "parts": ["hello", "world"]}, "create_time": 1730000001.0}, "root", ["m2"])}}
    (m,) = normalize.normalizer("openai")(conversations(spark, v)).collect()
    assert (m.conversation_id, m.message_id, m.parent_id, m.role, m.ts, m.text) == ("c1", "m1", "root", "user", 1730000001000, "hello\nworld")
    assert m.content.parts == ["hello", "world"]


@pytest.mark.parametrize("value, ts", [(1756622514.615, 1756622514615), ("1730000001", 1730000001000), (True, 1000), ("x", None), (None, None), ([1], None), ("NaN", None), (0, 5000), ("", 5000), (-1.5, -1500)])
def test_times_of_any_type(spark, value, ts):
    v = {"id": "c", "mapping": {"n": node({"create_time": value}, create_time=5)}}
    got = [m.ts for m in normalize.openai(conversations(spark, v)).collect()]
    assert got == ([5000 if value is None else ts] if ts is not None or value is None else [])


def test_odd_fields(spark):
    v = {
        "id": "c",
        "mapping": {
            "a": node({"author": None, "role": "tool", "content": "text", "create_time": 1}, 7),
            "b": node({"author": {"role": 3}, "content": {"content_type": 5, "parts": ["x", {"y": 1}, None, 2, "z"]}, "create_time": 1}, ""),
            "c": "no node",
            "d": node("no message"),
            "e": node({"id": "", "author": {"role": ""}, "content": {"content_type": "", "parts": {}}, "create_time": 1}),
        },
    }
    got = rows(normalize.openai(conversations(spark, v)), "message_id", "parent_id", "role", "content.content_type", "text")
    assert got == sorted([("a", None, "tool", "text", ""), ("b", "", "unknown", "text", "x\nz"), ("e", None, "unknown", "", "")], key=repr)


def test_mapping_of_other_types_and_empty(spark):
    assert normalize.openai(conversations(spark, {"id": "c", "mapping": []}, {"id": "d"}, {"id": "e", "mapping": {}}, {"id": "f", "mapping": None})).count() == 0


@pytest.mark.parametrize("v, cid", [({"conversation_id": "a", "id": "b"}, "a"), ({"conversation_id": "", "id": "b"}, "b"), ({"uuid": "u"}, "u"), ({"conversation_id": 5, "id": "b"}, "dump-7"), ({}, "dump-7")])
def test_conversation_id(spark, v, cid):
    df = conversations(spark, v)
    assert df.select(normalize.conversation_id("v", F.col("source"))).first()[0] == cid


def test_conversation_id_without_source(spark):
    df = conversations(spark, {"title": "t", "create_time": 5})
    assert df.select(normalize.conversation_id("v")).first()[0] == df.select(F.substring(F.sha1(F.lit("t|5")), 1, 12)).first()[0]


def test_flat_providers(spark):
    v = {"uuid": "c", "chat_messages": [{"uuid": "1", "sender": "human", "text": "hi", "created_at": "2024-01-01T00:00:00Z"}, {"sender": "model", "content": "yo", "create_time": 1704067201}]}
    got = rows(normalize.normalizer("Claude")(conversations(spark, v)), "message_id", "role", "ts", "text")
    assert got == [("1", "user", 1704067200000, "hi"), ("c-1", "assistant", 1704067201000, "yo")]


def test_unknown_provider():
    with pytest.raises(AdapterError):
        normalize.normalizer("nobody")


def test_parts_to_text(spark):
    v = conversations(spark, {"p": ["a ", {"text": "b"}, {"delta": "c"}]}, {"p": ["a", {"x": 1}, 3]}, {"p": []}, {})
    parts = F.try_variant_get("v", "$.p", "array<variant>")
    got = [tuple(x) for x in v.orderBy("line_no").select(normalize.flatten_parts(parts), normalize.flatten_parts(parts, strict=True)).collect()]
    assert got == [("a b c", "a b c"), ('a {"x":1} 3', None), ("", ""), (None, None)]


@pytest.mark.parametrize("content, text", [(None, ""), ("a\n b", "a b"), ({"parts": ["x", "y"]}, "x y"), ({"text": "t"}, "t"), ({"data": 4}, "4"), ({"k": "v"}, '{"k":"v"}')])
def test_content_text(spark, content, text):
    df = conversations(spark, {"c": content})
    assert df.select(normalize.content_text(F.try_variant_get("v", "$.c", "variant"))).first()[0] == text


def test_thread_totals(spark):
    m = spark.createDataFrame([("p", "c", "m2", 5, {"model": "b"}), ("p", "c", "m1", 5, {"model": "a"}), ("p", "c", "m0", None, None), ("p", "d", "m", 1, {})], "provider_id string, conversation_id string, message_id string, ts bigint, meta map<string,string>")
    index = threads.thread_index(m)
    assert rows(index) == [("p", "c", 3, 5, 5, ["a", "b"]), ("p", "d", 1, 1, 1, [])]
    assert threads.run_stats(index).first() == (2, 4)
    assert threads.run_stats(threads.thread_index(m.limit(0))).first() == (0, 0)
    assert rows(threads.positions(m), "message_id", "position") == [("m", 1), ("m0", 3), ("m1", 1), ("m2", 2)]


def test_tree_views(spark):
    n = spark.createDataFrame([("c", "r", None, ["a", "a", "lost"], 1.0), ("c", "a", "r", [], None), ("d", "x", None, [], 1.0), ("d", "y", "x", None, 2.0), ("d", "o", "gone", [], 0.5)], "conversation_id string, node_id string, parent string, children array<string>, create_time double")
    assert rows(tree.child_edges(n)) == [("c", "r", "a")]
    assert rows(tree.edges(n)) == [("c", "r", "a"), ("d", "x", "y")]
    assert rows(tree.roots(n)) == [("c", "r"), ("d", "o"), ("d", "x")]
    assert rows(tree.orphans(n)) == [("d", "o", "gone")]
    assert rows(tree.reading_order(n), "node_id", "position") == [("a", 2), ("o", 1), ("r", 1), ("x", 2), ("y", 3)]


def test_declared_fields(spark):
    from chatlake.operators import fieldmap

    df = conversations(spark, {"id": "a", "who": {"r": "Tool"}, "t": "5.5", "parts": ["x", 1, "y"]}, {"id": None}, {"id": "b", "t": {}})
    m = fieldmap.FieldMap({"message_id": "$.id", "role": "$.who.r | lower | nobody", "ts": "$.t | epoch_ms", "text": "$.parts | strings | join | none", "x": "$.x | null"}, values={"role": {"tool": "function"}})
    assert rows(fieldmap.apply_map(df, m), "message_id", "role", "ts", "text", "x") == [("a", "function", 5500, "x\ny", None), ("b", "nobody", None, "none", None)]
    for bad in ("id", "$.a | lower | epoch_ms", "$.a; drop"):
        with pytest.raises(AdapterError):
            fieldmap.compile_expression(bad)
    t = spark.createDataFrame([("c", 1, None), ("c", 2, 5), ("c", 3, None), ("d", 1, None)], "conversation_id string, position int, ts bigint")
    assert rows(fieldmap.monotonic_times(t)) == sorted([("c", 1, 5), ("c", 2, 5), ("c", 3, 5), ("d", 1, None)], key=repr)
    assert AdapterError("x").payload() == {"code": "LP2200", "type": "AdapterError", "message": "x"}


def test_preferred_text_and_structure(spark):
    df = conversations(spark, {"c": {"summary": "s"}}, {"c": {"summary": 3, "parts": ["a", {"text": "b"}]}}, {"c": ["x", {"q": 1}]}, {"c": "t"}, {"c": None}).orderBy("line_no")
    c = F.try_variant_get("v", "$.c", "variant")
    got = [tuple(r) for r in df.select(normalize.normalize_text(c, ("summary",)), normalize.normalize_text(c, ("summary",), loose=False)).collect()]
    assert got == [("s", "s"), ("a b", "a b"), ('x {"q":1}', '["x",{"q":1}]'), ("t", "t"), ("", "")]
    shape = [(r.s.content_type, r.s.parts) for r in df.select(normalize.normalize_structure(c, ("summary",)).alias("s")).collect()]
    assert shape[:4] == [("text", ["s"]), ("text", ["a", '{"text":"b"}']), ("text", ["x", '{"q":1}']), ("text", ["t"])]
