import random
import unicodedata

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chatlake.llm import lookalike as look

ZW, SHY, NBSP, WIDE = chr(0x200B), chr(0xAD), chr(0xA0), chr(0x3000)


def wide(t):
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else WIDE if c == " " else c for c in t)


@pytest.mark.parametrize(
    "a, b",
    [
        ("résumé", "re" + chr(0x301) + "sume" + chr(0x301)),
        ("final office", chr(0xFB01) + "nal o" + chr(0xFB03) + "ce"),
        ("Entry 42.", wide("Entry 42.")),
        ("a b", f"a{NBSP}b"),
        ("outline", f"out{ZW}l{SHY}ine"),
        ("scope", "s" + chr(0x441) + chr(0x43E) + chr(0x440) + chr(0x435)),
        ("TABLE", chr(0x3A4) + chr(0x410) + "BLE"),
        ("カタログ", "ｶﾀﾛｸﾞ"),
        ("ë", chr(0x451)),
        ("a-b", "a" + chr(0x2011) + "b"),
        ("x\ny", "x  \r\ny\n\n"),
        ("한글", unicodedata.normalize("NFD", "한글")),
        ("q" + chr(0x323) + chr(0x307), "q" + chr(0x307) + chr(0x323)),
        ("noon", "ոⲟⲟո"),
        ("LISA", "ꓡꓲꓢꓮ"),
        ("mild", "ⅿⅰⅼⅾ"),
    ],
)
def test_same_look(a, b):
    assert look.canonical(a) == look.canonical(b)


@pytest.mark.parametrize("a, b", [("resume", "résumé"), ("Ab", "AB"), ("10", "1" + chr(0x2070)), ("a", "ª"), ("a.", "a,"), ("a-b", "a" + chr(0x2013) + "b"), ("a b", "ab"), ("s", chr(0x17F)), ("n", "ñ")])
def test_other_look(a, b):
    assert look.canonical(a) != look.canonical(b)


def test_segments_splice_to_the_whole():
    """Normalising only unstable segments equals normalising every character; the form is stable."""
    r = random.Random(2)
    pool = [*"abe \n", *map(chr, (0x301, 0x327, 0x308, 0x200B, 0x430, 0x3BF, 0xE9, 0xFB01, 0xFF21, 0x3000, 0xAC00, 0x1100, 0x1161, 0x11A8, 0xFF76, 0xFF9E, 0x1F600, 0x6F22, 0x9, 0x2028))]
    for _ in range(3000):
        t = "".join(r.choice(pool) for _ in range(r.randint(0, 14)))
        whole = unicodedata.normalize("NFC", "".join(look._fold(c) for c in t.replace("\r\n", "\n")))
        got = look.canonical(t)
        assert got == look._LINE_ENDS.sub("", whole).strip(" \n"), ascii(t)
        assert look.canonical(got) == got


def test_pairs(spark):
    m = spark.createDataFrame(
        [("b", ["caf" + chr(0xE9)], "x"), ("a", ["cafe" + chr(0x301)], "x"), ("a", ["cafe" + chr(0x301)], "x"), ("c", ["caf" + chr(0xE9)], "x"), ("d", ["cafe"], "x"), ("e", [""], "x"), ("f", [ZW], "x"), ("g", [" "], "x"), ("h", None, "x"), ("i", [None, "x" * 50_000], "x"), ("j", ["x" * 50_000 + ZW], "x"), (None, ["caf" + chr(0xE9) + ZW], "x"), ("k", ["p", "q"], "x"), ("l", ["p\nq "], "x")],
        "node_id string, parts array<string>, form string",
    )
    assert rows(look.lookalike_pairs(m)) == [("a", "b"), ("a", "c"), ("i", "j"), ("k", "l")]
    assert look.lookalike_pairs(m.limit(0)).count() == 0
    forms = {(r.node_id, r.part_no): r.text for r in look.canonical_parts(m).collect()}
    assert forms["a", 0] == forms["b", 0] and ("i", 0) not in forms and forms["e", 0] == ""


def test_line_ends_at_the_end_of_a_text(spark):
    texts = [t + e for t in ("hello", "a \nb") for e in ("", "\r", "\r\n", "\x85", " ", " ", "\n")]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", look.canonical_column(F.col("t")).alias("form"))
    assert [(r.t, r.form) for r in df.collect()] == [(t, look.canonical(t)) for t in texts]
