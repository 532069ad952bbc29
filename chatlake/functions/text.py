"""Text functions on columns: splitting into lines, stripping, sanitising, the light formatter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line breaks and the white space of Unicode strings, as regular expressions.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
WHITE = r"[\s\p{Z}\x1c-\x1f\x85]"
FENCE = "```"
# Characters that file names may not hold.
FORBIDDEN = r'[<>:"/\\|?*\x00-\x1F]'


def strip(c: Column) -> Column:
    """``c`` without white space of any script at its ends."""
    return F.regexp_replace(c, rf"(?U)^{WHITE}+|(?<!{WHITE}){WHITE}+$", "")


def split_lines(c: Column) -> Column:
    """Lines of ``c`` at every Unicode line break; a final break opens no further line."""
    lines = F.split(c, LINE_BREAK)
    return F.when(c == "", F.array().cast("array<string>")).when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def sanitize(c: Column) -> Column:
    """One line: no-break spaces to spaces, controls deleted, white space collapsed, ends stripped."""
    c = F.regexp_replace(F.regexp_replace(c, r"\x{A0}", " "), r"[\x00-\x1F\x7F]", "")
    return strip(F.regexp_replace(c, rf"(?U){WHITE}+", " "))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once per row."""
    return F.transform(F.array(value), use)[0]


def light_format(c: Column) -> Column:
    """Runs of blank lines outside code become one empty line, an open code fence is closed, blank lines at the end go.

    In linear time within a row (no shuffle): the fences cut the lines into stretches that lie outside and inside code in
    turn; outside, a blank line stays if the line before it is not blank.
    """
    start = rf"(?U)^{WHITE}*"
    kind = lambda x: F.when(x.rlike(start + FENCE), "f").when(x.rlike(rf"(?U)\A{WHITE}*\z"), "b").otherwise("t")

    def stretch(lines: Column, kinds: Column, fences: Column, k: Column) -> Column:
        first = F.when(k == 0, F.lit(1)).otherwise(F.try_element_at(fences, k))
        last = F.when(k == F.size(fences), F.size(lines)).otherwise(F.try_element_at(fences, k + 1) - 1)
        own = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        blank = lambda i: (k % 2 == 0) & (kinds[i - 1] == "b")
        kept = F.filter(own, lambda i: ~(blank(i) & (i > first) & (kinds[i - 2] == "b")))
        return F.transform(kept, lambda i: F.when(blank(i), F.lit("")).otherwise(lines[i - 1]))

    def formatted(lines: Column, kinds: Column) -> Column:
        fences = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: kinds[i - 1] == "f")
        whole = _let(fences, lambda f: F.concat(F.flatten(F.transform(F.sequence(F.lit(0), F.size(f)), lambda k: stretch(lines, kinds, f, k))), F.when(F.size(f) % 2 == 1, F.array(F.lit(FENCE))).otherwise(F.array().cast("array<string>"))))
        # Lines in code keep their blank ends: they are followed by the closing fence.
        return F.regexp_replace(F.array_join(whole, "\n"), r"(?<!\n)\n+\z", "")

    return _let(split_lines(c), lambda lines: F.when(F.size(lines) == 0, F.lit("")).otherwise(_let(F.transform(lines, kind), lambda kinds: formatted(lines, kinds))))


def text_or_parts(text: Column, parts: Column) -> Column:
    """``text``, or the parts joined by line feeds where it is empty or null."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.coalesce(F.array_join(parts, "\n"), F.lit(""))).otherwise(text)


def sanitize_filename(c: Column, max_len: int = 120) -> Column:
    """``c`` as a file name: forbidden characters become ``_``, white space is collapsed, long names keep their extension after ``...``."""
    c = F.regexp_replace(c, FORBIDDEN, "_")
    c = strip(F.regexp_replace(c, rf"(?U){WHITE}+", " "))
    ext = F.regexp_extract(c, r"(\.[^.]*)$", 1)
    root = F.substring(c, F.lit(1), F.length(c) - F.length(ext))
    return F.when(F.length(c) > max_len, F.concat(F.substring(root, F.lit(1), F.greatest(F.lit(max_len - 3) - F.length(ext), F.lit(0))), F.lit("..."), ext)).otherwise(c)


def yaml_list(c: Column) -> Column:
    """``["a", "b"]`` of an array, without escaping."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]"))


def mask(c: Column, patterns: list[str], by: str = "***") -> Column:
    """``c`` with every match of the patterns replaced."""
    for p in patterns:
        c = F.regexp_replace(c, p, by)
    return c
