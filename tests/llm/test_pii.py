import numpy as np
import pytest
from conftest import rows

from pii_held_out import NOBODY, SENTENCES

from chatlake.llm import pii, pii_model, pii_training


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(pii.MODEL.read_bytes())


def test_gradients():
    """Analytic gradients of the tagger equal numeric ones."""
    rng = np.random.default_rng(0)
    t = pii_model.Tagger(list("abcdef"), hidden=4, embed=3)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    first = len(pii_model.CLASSES)
    x = rng.integers(first, first + 6, (7, 3)).astype(np.int32)
    y = rng.choice([0, 1, 3, 5], (7, 3))
    mask = np.arange(7)[:, None] < np.array([7, 5, 3])[None]
    _, g = t.step(x, y, mask)
    for k in g:
        i = (int(x[1, 0]), 1) if k == "E" else tuple(rng.integers(0, s) for s in t.p[k].shape)
        old, e = t.p[k][i], 1e-3
        t.p[k][i] = old + e
        a, _ = t.step(x, y, mask)
        t.p[k][i] = old - e
        b, _ = t.step(x, y, mask)
        t.p[k][i] = old
        assert abs((a - b) / 2 / e - g[k][i]) < 2e-3 + 0.05 * abs(g[k][i]), k


def test_decoding_never_breaks_a_span(finder):
    for tags in finder.tagger.decode(["call me on 212-555-0142 or write to ann.lee@b.test, Ann", "x", "My name is Ida Berg."]):
        for a, b in zip(tags, tags[1:]):
            assert not pii_model.FORBIDDEN[a, b]


@pytest.mark.parametrize("kind", pii_model.KINDS)
def test_recall_on_held_out_sentences(finder, kind):
    """Names, numbers and wordings that training does not hold: nine of ten spans of each kind are met."""
    hits = total = 0
    for marked in SENTENCES:
        text, spans = pii_training.labelled(marked)
        found = finder.spans([text])[0]
        for a, b, k in spans:
            if k == kind:
                total += 1
                hits += any(k == kk and x < b and a < y for x, y, kk in found)
    assert total >= 12 and hits / total >= 0.9


def test_texts_that_name_nobody(finder):
    assert sum(bool(s) for s in finder.spans(NOBODY)) <= 1


def test_made_sentences(finder):
    """Sentences made with another seed, among fillers: nearly all spans are found, and hardly any other."""
    fillers = {"en": ["The old ferry needs 12 litres more fuel than the captain wrote down.", "Put the kettle on the second shelf and wash the rest before lunch."]}
    maker = pii_training.Maker(fillers, seed=991)
    right = wrong = missed = 0
    for _ in range(400):
        text, spans = pii_training.labelled(f"{maker.pick(fillers['en'])} {maker.mention()} {maker.pick(fillers['en'])} {maker.trap()}")
        want = {k for _, _, k in spans}
        got = {k for _, _, k in finder.spans([text])[0]}
        right, wrong, missed = right + len(want & got), wrong + len(got - want), missed + len(want - got)
    assert right / (right + missed) > 0.92 and right / (right + wrong) > 0.92


def test_decoding_without_search_is_exact(finder):
    """Texts that are not searched are those in which the search finds nothing."""
    texts = [pii_training.labelled(s)[0] for s in SENTENCES] + NOBODY
    t = finder.tagger
    for text, fast in zip(texts, t.decode(texts)):
        x = t.encode(text)[:, None]
        active = np.ones(len(text), np.int64)
        e = t._states(x, active, "f") @ t.p["V"][: t.hidden] + t._states(x, active, "b") @ t.p["V"][t.hidden :] + t.p["c"]
        trans = np.where(pii_model.FORBIDDEN, -1e4, t.p["T"]).astype(np.float32)
        start = (t.p["S"] + np.where(pii_model.STARTS_INSIDE, -1.0, 0.0)).astype(np.float32)
        assert (t._viterbi(e, np.ones((len(text), 1), bool), trans, start)[:, 0] == fast).all()


def test_windows_are_reconciled(finder):
    """The same mention is found wherever it stands in a long text."""
    filler = "The lentil soup needs 12 grams more leek than the tutor wrote down. "
    for n in range(0, 200, 13):
        text = filler * 3 + "x" * n + " Call me on 212-555-0142. " + filler * 3
        assert {k for _, _, k in finder.spans([text])[0]} >= {"phone"}


@pytest.mark.parametrize("span, kind, ok", [("Ann Lee", "name", True), ("Ann 3", "name", False), ("a@b.test", "email", True), ("nothing", "email", False), ("212-555-0142", "phone", True), ("12", "phone", False), ("912-33-3516", "id_number", True), ("AB", "id_number", False), ("12 Elm Street", "address", True), ("Elm Street", "address", False)])
def test_plausible(span, kind, ok):
    assert pii.plausible(span, kind) is ok


def test_masking():
    assert pii.masked("ask Ann Lee at 5", [(4, 11, "name")]) == "ask [NAME] at 5"


def test_found_and_masked(spark):
    m = spark.createDataFrame(
        [("a", ["hello", "Call me on 212-555-0142. Contact: ann.berg@quilldesk.example"], "c"), ("a", ["hello", "Call me on 212-555-0142. Contact: ann.berg@quilldesk.example"], "c"), ("b", None, "c"), ("d", [None, "My name is Ingrid Falkenrath."], "c"), ("e", [""], "c"), (None, ["The clerk noted SSN 912-33-3516."], "c"), ("f", ["word " * 20_000 + "Call me on 212-555-0142."], "c")],
        "node_id string, parts array<string>, kind string",
    )
    want = [("a", 1, "email"), ("a", 1, "phone"), ("d", 1, "name"), (None, 0, "id_number"), ("f", 0, "phone")]
    assert rows(pii.pii_found(m)) == sorted(want, key=repr)
    text = dict(((r.node_id, r.part_no), r.text) for r in pii.masked_parts(m).collect())
    assert text["a", 1] == "Call me on [PHONE]. Contact: [EMAIL]" and text["e", 0] == "" and text["a", 0] == "hello"
    assert pii.pii_found(m.limit(0)).count() == 0


@pytest.mark.parametrize("text, kind, span", [("It is 06 12 34 56 78.", "phone", "06 12 34 56 78"), ("My name is Will Page.", "name", "Will Page"), ("My name is River Coach.", "name", "River Coach"), ("Put the rest before lunch. My name is Will Page.", "name", "Will Page")])
def test_common_words_and_short_groups_are_read(finder, text, kind, span):
    """Texts of common words and pairs of digits are read too."""
    assert [(text[a:b], k) for a, b, k in finder.spans([text])[0]] == [(span, kind)]


def test_every_character_is_read(finder):
    text = "put the rest before lunch " * 40
    read = set()
    for a, b in finder.windows(text):
        read.update(range(a, b))
    assert read == set(range(len(text)))


def test_headings_of_one_common_word_are_no_names(finder):
    assert finder.spans(["Summary\n=======\n\nPut the rest before lunch.", "## Summary\n\nPut the rest before lunch."]) == [[], []]
