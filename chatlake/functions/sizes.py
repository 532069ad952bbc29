"""Sizes in bytes: literals such as ``4M`` and texts such as ``1.5MiB``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the units; a bare letter and ``KiB`` count by 1024, ``KB`` by 1000.
UNITS = ("B", "KiB", "MiB", "GiB", "TiB")
SUFFIXES = {"": 1, "B": 1, "IB": 1}
for _power, _unit in enumerate(UNITS[1:4], 1):
    SUFFIXES |= {_unit[0]: 1024**_power, _unit.upper(): 1024**_power, _unit[0] + "B": 1000**_power}


def parse_size(text: str) -> int:
    """Bytes of a size literal: whole digits and a suffix of ``SUFFIXES`` in any case; decimals are no sizes."""
    t = text.strip()
    suffix = t.lstrip("0123456789")
    digits = t[: len(t) - len(suffix)]
    if not digits or suffix.strip().upper() not in SUFFIXES:
        raise ValueError(f"invalid size: {text}")
    return int(digits) * SUFFIXES[suffix.strip().upper()]


def parse_size_column(c: Column) -> Column:
    """``parse_size`` on a column; null of what is no size."""
    t = F.regexp_replace(F.upper(c), r"^\s+|\s+$", "")
    digits = F.regexp_substr(t, F.lit("^[0-9]+"))
    suffix = F.regexp_replace(F.substring(t, F.length(digits) + 1, F.length(t)), r"^\s+", "")
    factors = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))
    return F.try_multiply(digits.try_cast("bigint"), F.try_element_at(factors, suffix).cast("bigint"))


def format_bytes(c: Column) -> Column:
    """Bytes with one decimal in the largest binary unit that keeps the number at or over one; halves round to even."""
    v = c.cast("double")
    out = None
    for k in range(len(UNITS) - 1, -1, -1):
        text = F.concat(F.format_string("%.1f", F.bround(v / float(1024**k), 1)), F.lit(UNITS[k]))
        out = text if out is None else F.when(v < float(1024 ** (k + 1)), text).otherwise(out)
    return F.when(c.isNotNull(), out)
