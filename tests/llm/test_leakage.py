import random

from conftest import rows

from chatlake.llm import leakage


def brute(passages, text, width):
    w = leakage.words(text)
    runs = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return {item for item, p in passages if p in runs}


def test_search_agrees_with_brute_force():
    r = random.Random(4)
    for _ in range(300):
        width = r.randint(1, 6)
        passages = [(i, tuple(r.choice("abc") for _ in range(width))) for i in range(r.randint(1, 12))]
        text = " ".join(r.choice("abcd") for _ in range(r.randint(0, 60)))
        assert leakage.Matcher(passages, width).search(text) == brute(passages, text, width)


def test_leaks(spark):
    shared = "you will be given a short statement decide whether it is entailed or not by the text"
    own1 = "between the old mill and the harbour the road crosses eleven wooden bridges and one ferry"
    own2 = "the curator notes that no seasonal quarry survived the great flood although forty fragments did today"
    items = spark.createDataFrame([(1, f"{shared}. {own1}", "x"), (2, f"{shared}. {own2}", "x"), (3, "too short", "x"), (4, None, "x"), (5, "the same prompt twice " * 4, "x"), (6, "the same prompt twice " * 4, "x"), (None, own1 + " more words", "x")], "item_id bigint, prompt string, doc_id string")
    w = own1.split()
    docs = spark.createDataFrame(
        [
            (1, f"Intro. {own1.upper()}! End", "k"),
            (2, "-".join(w[2:14]), "k"),
            (3, " ".join(w[:11]), "k"),
            (4, shared, "k"),
            (5, f"x {own2} y\n{own1}", "k"),
            (5, f"x {own2} y\n{own1}", "k"),
            (6, None, "k"),
            (7, "", "k"),
            (8, "the same prompt twice " * 9, "k"),
            (9, "filler " * 50_000 + own2, "k"),
            (None, own1, "k"),
        ],
        "doc_id bigint, text string, item_id string",
    )
    want = [(1, 1), (2, 1), (5, 1), (5, 2), (9, 2)]
    assert rows(leakage.leaked_items(docs, items)) == want
    assert leakage.leaked_items(docs.limit(0), items).count() == 0
    assert leakage.leaked_items(docs, items.limit(0)).count() == 0


def test_several_passes_agree(spark, monkeypatch):
    r = random.Random(8)
    prompts = [" ".join(r.choice("abcdefghijklmnop") for _ in range(40)) for _ in range(12)]
    items = spark.createDataFrame(list(enumerate(prompts)), "item_id bigint, prompt string")
    docs = spark.createDataFrame([(i, " ".join(r.choice(prompts).split()[5:25])) for i in range(40)], "doc_id bigint, text string")
    one = rows(leakage.leaked_items(docs, items))
    monkeypatch.setattr(leakage, "PASSAGES_A_PASS", 60)
    assert rows(leakage.leaked_items(docs, items)) == one and one


def test_own_runs_longer_than_the_width(spark):
    """A run may be an item's own though each of its passages of 12 words stands in another item."""
    w = [f"w{i}" for i in range(16)]
    items = spark.createDataFrame([(1, "start " + " ".join(w[:13]) + " end"), (2, "x " + " ".join(w[:12]) + " y"), (3, "z " + " ".join(w[1:13]) + " v")], "item_id bigint, prompt string")
    docs = spark.createDataFrame([(1, "a " + " ".join(w[:13]) + " b"), (2, "a " + " ".join(w[:12]) + " b"), (3, "a " + " ".join(w[1:13]) + " b")], "doc_id bigint, text string")
    assert rows(leakage.leaked_items(docs, items)) == [(1, 1)]


def test_leaks_agree_with_brute_force(spark):
    r = random.Random(6)
    prompts = [[r.choice("ab") for _ in range(r.randint(3, 24))] for _ in range(14)]
    texts = [r.choice("ab c".split() + prompts) for _ in range(30)]
    texts = [[*"ba", *list(t)[r.randint(0, 3) :][: r.randint(3, 14)], *"ab"] for t in texts]

    def holds(a, b):
        return any(a[i : i + len(b)] == b for i in range(len(a) - len(b) + 1))

    want = set()
    for i, p in enumerate(prompts):
        own = [p[a:b] for a in range(len(p)) for b in range(a + 4, len(p) + 1) if not any(holds(q, p[a:b]) for j, q in enumerate(prompts) if j != i)]
        want |= {(d, i) for d, t in enumerate(texts) if any(holds(t, x) for x in own)}
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(prompts)], "item_id bigint, prompt string")
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id bigint, text string")
    assert want and rows(leakage.leaked_items(docs, items, 4)) == sorted(want, key=repr)
