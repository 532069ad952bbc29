import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chatlake.functions import sizes, text, times


def formatted(raw):
    """The light format, line by line."""
    out, code, blank = [], False, False
    for line in raw.splitlines():
        if line.lstrip().startswith("```"):
            code, blank = not code, False
            out.append(line)
        elif code or line.strip():
            out.append(line)
            blank = blank and code
        else:
            if not blank:
                out.append("")
            blank = True
    if code:
        out.append("```")
    while out and out[-1] == "":
        out.pop()
    return "\n".join(out)


def test_light_format(spark):
    r = random.Random(1)
    pieces = ["a", "```", " ```py", "", "  ", "\t", "b c", chr(0x3000), "~~~"]
    breaks = ["\n", "\r\n", "\r", "\x0b", chr(0x85), chr(0x2028)]
    texts = ["".join(r.choice(pieces) + r.choice(breaks) for _ in range(r.randint(0, 12))) + r.choice(pieces) for _ in range(400)] + ["", "\n", "\n\n\na\n\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: x.o for x in df.select("i", text.light_format(F.col("t")).alias("o")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == formatted(t), repr(t)


def test_null_text_stays_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(text.light_format(F.col("t")), text.sanitize(F.col("t")), text.strip(F.col("t"))).first() == (None, None, None)


def test_sanitize(spark):
    df = spark.createDataFrame([("a" + chr(0xA0) + " b\x00\nc\t ",), ("  ",)], "t string")
    assert [x[0] for x in df.select(text.sanitize(F.col("t"))).collect()] == ["a bc", ""]


def test_sanitize_filename(spark):
    names = ['a<b>:"c/d\\e|f?g*h.md', " x \t y ", "n" * 200 + ".md", "m" * 150]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    got = [x[0] for x in df.select(text.sanitize_filename(F.col("t"))).collect()]
    assert got[:2] == ["a_b___c_d_e_f_g_h.md", "x _ y"]
    assert got[2] == "n" * 114 + "....md" and len(got[2]) == 120
    assert got[3] == "m" * 117 + "..."


@pytest.mark.parametrize("literal, size", [("4096", 4096), ("4M", 4 << 20), ("512k", 512 << 10), ("1G", 1 << 30), ("4MB", 4_000_000), ("4MiB", 4 << 20), ("512KiB", 512 << 10), ("4B", 4), (" 7 K ", 7 << 10)])
def test_parse_size(spark, literal, size):
    assert sizes.parse_size(literal) == size
    assert spark.range(1).select(sizes.parse_size_column(F.lit(literal))).first()[0] == size


@pytest.mark.parametrize("literal", ["", "x", "1.5M", "-3", "4 T"])
def test_no_size(spark, literal):
    with pytest.raises(ValueError):
        sizes.parse_size(literal)
    assert spark.range(1).select(sizes.parse_size_column(F.lit(literal))).first()[0] is None


def test_format_bytes(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (1280,), (5 << 30,), (3 << 50,), (None,)], "n bigint")
    assert [x[0] for x in df.select(sizes.format_bytes(F.col("n"))).collect()] == ["0.0B", "1023.0B", "1.0KiB", "1.2KiB", "5.0GiB", "3072.0TiB", None]


def test_times(spark):
    df = spark.createDataFrame([(1756622514615,), (1756622514,), (1756622514000,), (None,)], "ts bigint")
    assert [tuple(x) for x in df.select(times.iso_utc(F.col("ts")), times.local_human(F.col("ts"), "Asia/Tokyo"), times.local_human(F.col("ts"), "UTC", "ja")).collect()] == [
        ("2025-08-31T06:41:54.615000+00:00", "2025-08-31 15:41", "2025年08月31日 06:41"),
        ("2025-08-31T06:41:54+00:00", "2025-08-31 15:41", "2025年08月31日 06:41"),
        ("2025-08-31T06:41:54+00:00", "2025-08-31 15:41", "2025年08月31日 06:41"),
        ("", "", ""),
    ]
    seconds = spark.createDataFrame([(1.9999,), (-1.5,), (float("nan"),), (None,), (1730000001.0,)], "s double")
    assert [x[0] for x in seconds.select(times.epoch_ms(F.col("s"))).collect()] == [1999, -1500, None, None, 1730000001000]


def test_mask_and_lists(spark):
    df = spark.createDataFrame([("mail a@b.c now", ["a", "b"]), (None, [])], "t string, l array<string>")
    assert rows(df.select(text.mask(F.col("t"), [r"\S+@\S+"]), text.yaml_list(F.col("l")))) == sorted([("mail *** now", '["a", "b"]'), (None, "[]")], key=repr)
    assert re.fullmatch(text.LINE_BREAK.replace(r"\x{2028}\x{2029}", ""), "\r\n")
