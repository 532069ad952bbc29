"""Problem 1: one consistent form for texts that look the same.

Method: quick-check properties isolate the unstable segments of a text - characters that change
under the form, or that may combine with the one before. Only those, with one character of
boundary context, are normalised, and the canonical segments are spliced into the unchanged text.
Texts that pass the quick check as a whole never leave the JVM.

The form: canonical composition; wide, narrow, ligature and presentation forms as the letters
they show; every space as U+0020 and every line break as a line feed; characters without ink
removed; letters of other scripts as the Latin letter of the same shape. Case, accents, digits,
superscripts and punctuation stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from chatlake.session import materialize

# Letters of other scripts and the letter whose shape they share.
SAME_SHAPE = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "Ѵ": "V", "ѵ": "v", "Ү": "Y", "һ": "h", "Ӏ": "I", "ӏ": "l", "ԁ": "d", "Ԛ": "Q", "ԛ": "q", "Ԝ": "W", "ԝ": "w",
    # Armenian
    "Օ": "O", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Տ": "S", "Լ": "L", "Ս": "U",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Letters and signs encoded twice
    "µ": "μ", "ɡ": "g", "‐": "-", "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}

# Characters without ink that are not of the format or control categories.
NO_INK = "".join(map(chr, (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x2800, 0x3164, 0xFFA0)))
#: Line breaks; CR LF is one.
BREAKS = "".join(map(chr, (0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029)))
#: Characters a JVM test may pass over: with only these, a text is in the form but for its edges.
STABLE = r"^[\x20-\x7E\n]*\z"

_LINE_ENDS = re.compile(r"(?<! ) +(?=\n)")

#: Decomposition tags under which a character looks like what it decomposes to.
_SHOWN = ("<wide>", "<narrow>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")


def _letters_of(ch: str) -> str | None:
    """What a compatibility character shows, if that is plain letters, a space or another width."""
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if not tag.startswith("<"):
        return None
    text = "".join(chr(int(c, 16)) for c in rest.split())
    if tag in _SHOWN:
        return text
    if tag == "<compat>" and (text == " " or len(text) > 1 and all(unicodedata.category(c)[0] == "L" for c in text)):
        return text
    return None


def _fold(ch: str) -> str:
    """One character in the form, before composition."""
    if ch == "\n":
        return ch
    if ch in BREAKS:
        return "\n"
    category = unicodedata.category(ch)
    if category == "Zs" and ch != " " or ch == "\t":
        return " "
    if category in ("Cf", "Cc") or ch in NO_INK or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF:
        return ""
    shown = _letters_of(ch)
    if shown is not None:
        return "".join(_fold(c) for c in shown)
    return "".join(SAME_SHAPE.get(c, c) for c in unicodedata.normalize("NFD", ch))


def _candidates() -> Iterator[int]:
    """Code points that may be unstable: all but the large blocks of ideographs, syllables and private use."""
    for first, last in ((0x80, 0x33FF), (0x4DC0, 0x4DFF), (0xA000, 0xABFF), (0xD7B0, 0xD7FF), (0xF900, 0x16FFF), (0x1AFF0, 0x1FFFF), (0x2F800, 0x2FA1F), (0xE0000, 0xE01EF)):
        yield from range(first, last + 1)


@lru_cache(1)
def unstable_segments() -> re.Pattern:
    """Matches an unstable run with the character before it."""
    second = set()  # characters that compose with the one before
    marks, folds = [], []
    for cp in _candidates():
        ch = chr(cp)
        parts = unicodedata.decomposition(ch)
        if parts and not parts.startswith("<") and " " in parts:
            second.add(int(parts.split()[1], 16))
        if unicodedata.combining(ch):
            marks.append(cp)
        elif unicodedata.normalize("NFC", _fold(ch)) != ch:
            folds.append(cp)
    points = sorted({*marks, *folds, *second, *range(0x1161, 0x1176), *range(0x11A8, 0x11C3), 9, 0x7F, *range(0, 10), *range(11, 32), *map(ord, SAME_SHAPE)} - {10})
    spans: list[list[int]] = []
    for cp in points:
        if spans and spans[-1][1] == cp - 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    cls = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    return re.compile(f"[^{cls}]?[{cls}]+")


@lru_cache(200_000)
def _canonical_segment(segment: str) -> str:
    return unicodedata.normalize("NFC", "".join(_fold(c) for c in segment))


def canonical(text: str) -> str:
    """``text`` in the form; spaces at line ends and blank edges are dropped, as they show nothing."""
    text = unstable_segments().sub(lambda m: _canonical_segment(m[0]), text.replace("\r\n", "\n"))
    return _LINE_ENDS.sub("", text).strip(" \n")


def _canonical_series(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else canonical(t) for t in texts], dtype=object)


def canonical_column(text: Column) -> Column:
    """The form of ``text``; only texts that fail the quick check are sent to Python."""
    plain = F.regexp_replace(F.regexp_replace(text, _LINE_ENDS.pattern, ""), r"^[ \n]+|(?<![ \n])[ \n]+$", "")
    return F.when(text.rlike(STABLE), plain).otherwise(pandas_udf(_canonical_series, "string")(F.when(~text.rlike(STABLE), text)))


def canonical_parts(mapping: DataFrame) -> DataFrame:
    """(node_id, part_no, text): every string of parts in the form. Null parts and elements give no rows."""
    parts = mapping.select("node_id", F.posexplode("parts").alias("part_no", "part")).where("part IS NOT NULL")
    return parts.select("node_id", "part_no", canonical_column(F.col("part")).alias("text"))


def lookalike_pairs(mapping: DataFrame) -> DataFrame:
    """(node_a, node_b): nodes whose texts differ as strings and look the same, node_a < node_b; distinct.

    A text is the node's parts joined by line feeds. Null ids, null parts and texts that show nothing take part in no pair.
    Distinct spellings are paired, then the nodes that hold them: copies of one spelling are never compared with each other.
    """
    texts = mapping.where("node_id IS NOT NULL AND parts IS NOT NULL").select("node_id", F.array_join("parts", "\n").alias("text")).where("text <> ''")
    forms = texts.select("node_id", "text", canonical_column(F.col("text")).alias("form")).where("form <> ''")
    # 128-bit digests stand for the texts in the shuffles.
    nodes = materialize(forms.select("node_id", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("text")).alias("spelling")).distinct(), "forms")
    spellings = nodes.groupBy("form", "spelling").count()
    several = spellings.groupBy("form").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(nodes.join(several, "form", "left_semi"), "shared")
    a = shared.select("form", F.col("spelling").alias("spelling_a")).distinct()
    b = shared.select("form", F.col("spelling").alias("spelling_b")).distinct()
    pairs = a.join(b, "form").where("spelling_a < spelling_b").select("spelling_a", "spelling_b")
    left = pairs.join(shared.select(F.col("spelling").alias("spelling_a"), F.col("node_id").alias("x")), "spelling_a")
    both = left.join(shared.select(F.col("spelling").alias("spelling_b"), F.col("node_id").alias("y")), "spelling_b").where("x <> y")
    return both.select(F.least("x", "y").alias("node_a"), F.greatest("x", "y").alias("node_b")).distinct()
