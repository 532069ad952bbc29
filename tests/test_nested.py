import json
import random

from conftest import rows

from chatlake.operators import nested

SCHEMA = "node_id string, message string, item_path string, other int"


def brute(value, path="", near="", inside=False):
    """Items by plain recursion."""
    out = []
    if isinstance(value, dict):
        if inside:
            out.append((path, near))
            near = path
        for k, v in value.items():
            out += brute(v, f"{path}.{k}" if path else k, near)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += brute(v, f"{path}[{i}]", near, True)
    return out


def made(r, depth):
    x = r.random()
    if depth == 0 or x < 0.3:
        return r.choice([1, 2.5, None, True, 'a"b', "x\\", "{[,]}:", "é日", ""])
    if x < 0.65:
        return [made(r, depth - 1) for _ in range(r.randint(0, 4))]
    return {r.choice(["a", "b", 'c"', "d\\", "é", "f:{"]) + str(i): made(r, depth - 1) for i in range(r.randint(0, 4))}


def test_index_agrees_with_recursion():
    r = random.Random(3)
    for _ in range(120):
        docs = [made(r, r.randint(0, 6)) for _ in range(15)]
        texts = [json.dumps(d, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])) for d in docs]
        got = nested.index_batch(texts)
        assert sorted(zip(got[0], got[1], got[2])) == sorted((i, *t) for i, d in enumerate(docs) for t in brute(d))
        assert all(isinstance(json.loads(b), dict) for b in got[5])


def test_links_parents_and_odd_rows(spark):
    data = [
        ("n1", '{"a":{"b":[{"c":[1,2,{"x":1}]}]},"d":[[{"y":2},{"z":[{}]}]]}', "clash", 1),
        ("n1", '{"a":{"b":[{"c":[1,2,{"x":1}]}]},"d":[[{"y":2},{"z":[{}]}]]}', "clash", 1),  # repeated
        ("n2", '{"a":[{"b":1}', None, 2),  # cut off
        ("n3", None, None, 3),
        ("n4", "", None, 4),
        (None, '[{"a":1}]', None, 5),
        ("n5", '{"a":"[{not an item}]"}', None, 6),
        ("n6", "[" * 5000, None, 7),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    want = [("n1", "a.b[0]", ""), ("n1", "a.b[0].c[2]", "a.b[0]"), ("n1", "d[0][0]", ""), ("n1", "d[0][1]", ""), ("n1", "d[0][1].z[0]", "d[0][1]"), (None, "[0]", "")]
    assert rows(nested.item_links(df)) == sorted(want, key=repr)
    assert nested.nested_items(df).count() == 11
    assert rows(nested.item_links(df.limit(0))) == []


def test_long_text(spark):
    long = json.dumps({"parts": [{"i": i, "text": "x" * 200} for i in range(8000)]})
    df = spark.createDataFrame([("n", long)], "node_id string, message string")
    assert nested.item_links(df).count() == 8000
