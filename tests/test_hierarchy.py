import random

import numpy as np
import pytest
from conftest import rows

from chatlake.operators import hierarchy


def brute(parents):
    out = {}
    for v in range(len(parents)):
        path, x, seen = [], v, set()
        while x >= 0 and x not in seen:
            seen.add(x)
            path.append(x)
            x = parents[x]
        out[v] = None if x >= 0 else list(reversed(path))
    return out


def test_contraction_agrees_with_walking():
    r = random.Random(5)
    for _ in range(200):
        n = r.randint(1, 60)
        p = [r.choice([-1, r.randrange(n), max(0, i - 1), max(0, i - 1)]) for i in range(n)]
        root, far, bad = hierarchy.contract(np.array(p), np.ones(n))
        for v, path in brute(p).items():
            assert bool(bad[v]) == (path is None)
            assert path is None or (root[v], far[v]) == (path[0], len(path) - 1)


def test_long_chain():
    n = 300_000
    _, far, bad = hierarchy.contract(np.arange(n) - 1, np.ones(n))
    assert far.max() == n - 1 and not bad.any()


@pytest.mark.parametrize("block", [1000, 25, 6])
def test_split_threads_agree(spark, block):
    """Threads beyond a block are contracted across blocks, with the same labels."""
    r = random.Random(9)
    data, want = [], []
    for c, n in (("a", 40), ("b", 80), ("c", 3), ("d", 25)):
        p = [(i + 1) % n for i in range(n)] if c == "d" else [r.choice([-1, r.randrange(n)] + [max(0, i - 1)] * 6) if i else -1 for i in range(n)]
        for i, path in brute(p).items():
            data.append((c, f"n{i}", f"n{p[i]}" if p[i] >= 0 else r.choice([None, "nowhere"])))
            names = [f"n{x}" for x in path or []]
            want.append((c, f"n{i}", names[0] if names else "", len(names) - 1, "/".join(names)))
    df = spark.createDataFrame(data, "conversation_id string, node_id string, parent_id string")
    got = hierarchy.label_forest(df, True, block)
    assert rows(got, "conversation_id", "node_id", "root_id", "depth", "path") == sorted(want, key=repr)


def test_links_of_odd_rows(spark):
    mapping = spark.createDataFrame(
        [
            ("c", "r", None, ["a", "gone"], 1),
            ("c", "r", None, ["a"], 1),  # an older copy
            ("c", "a", None, [], 2),  # known by r's children only
            ("c", "b", "gone", None, 3),  # its parent is no node
            ("c", "x", "y", None, 4),
            ("c", "y", "x", None, 5),  # a cycle
            ("c", "z", "y", None, 6),  # below it
            ("c", "s", "s", None, 7),  # its own parent
            (None, "q", None, None, 8),
            ("c", None, None, None, 9),
        ],
        "conversation_id string, node_id string, parent string, children array<string>, depth int",
    )
    parsed = spark.createDataFrame([("message", "p", "m1", None), ("message", "p", "m2", "m1"), ("thread", "p", None, None), ("message", "c", "other", None), ("message", None, "m3", None)], "record_type string, conversation_id string, message_id string, parent_id string")
    got = hierarchy.hierarchy(mapping, parsed, True)
    want = [("c", "r", "r", 0), ("c", "a", "r", 1), ("c", "b", "b", 0), ("c", "x", "", -1), ("c", "y", "", -1), ("c", "z", "", -1), ("c", "s", "", -1), ("p", "m1", "m1", 0), ("p", "m2", "m1", 1)]
    assert rows(got, "conversation_id", "node_id", "root_id", "depth") == sorted(want, key=repr)
    assert rows(hierarchy.descendants(got)) == [("c", "r", "a"), ("p", "m1", "m2")]
    assert hierarchy.hierarchy(mapping.limit(0), parsed.limit(0)).count() == 0


def test_descendants_of_every_node(spark):
    """Pairs with ids that hold slashes, deep threads in blocks, and a number for leaves and cyclic nodes."""
    chain = [("c", f"n/{i}%2F", f"n/{i - 1}%2F" if i else None) for i in range(12)]
    odd = [("c", "x", "y"), ("c", "y", "x"), ("c", "z", "y"), ("d", "only/one", None)]
    mapping = spark.createDataFrame([(*x, None) for x in chain + odd], "conversation_id string, node_id string, parent string, children array<string>")
    parsed = spark.createDataFrame([], "record_type string, conversation_id string, message_id string, parent_id string")
    pairs = [("c", chain[i][1], chain[k][1]) for i in range(12) for k in range(i + 1, 12)]
    numbers = [("c", chain[i][1], 11 - i) for i in range(12)] + [(c, n, 0) for c, n, _ in odd]
    for block in (1000, 5):
        got, counted = hierarchy.all_descendants(mapping, parsed, block)
        assert rows(got) == sorted(pairs, key=repr)
        assert rows(counted) == sorted(numbers, key=repr)


def test_the_query_on_descendants_gives_pairs(spark, tmp_path):
    from chatlake.plans import general

    spark.createDataFrame([("c", "r", None, ["a"]), ("c", "a", "r", None)], "conversation_id string, node_id string, parent string, children array<string>").write.parquet(f"{tmp_path}/mapping.parquet")
    spark.createDataFrame([], "record_type string, conversation_id string, message_id string, parent_id string").write.parquet(f"{tmp_path}/parsed.parquet")
    assert rows(general.QUERIES["p7_descendants"](spark, str(tmp_path)), "conversation_id", "node_id", "descendant_id") == [("c", "r", "a")]
    assert rows(general.QUERIES["p7_descendant_counts"](spark, str(tmp_path))) == [("c", "a", 0), ("c", "r", 1)]
