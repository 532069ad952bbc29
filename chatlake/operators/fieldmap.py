"""Declared field mappings: message columns from expressions such as ``$.author.role | lower | user``.

An expression is a path into a VARIANT, then functions, then (last, if it is none of their names) a
default. A provider that differs only in where its fields stand needs a mapping, not code.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.errors import AdapterError
from chatlake.functions.text import sanitize, strip
from chatlake.functions.times import epoch_ms, millis
from chatlake.operators.normalize import seconds, string

#: Functions of an expression: from the VARIANT or from what the functions before gave.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "string": string,
    "epoch_ms": lambda x: epoch_ms(seconds(x)),
    "millis": lambda x: millis(F.try_variant_get(x, "$", "bigint")),
    "bool": lambda x: F.try_variant_get(x, "$", "boolean"),
    "strings": lambda x: F.filter(F.transform(F.try_variant_get(x, "$", "array<variant>"), string), lambda s: s.isNotNull()),
    "json": F.to_json,
    "lower": F.lower,
    "upper": F.upper,
    "strip": strip,
    "sanitize": sanitize,
    "join": lambda x: F.array_join(x, "\n"),
}
#: Functions that take the VARIANT itself.
FIRST = {"string", "epoch_ms", "millis", "bool", "strings", "json"}


@dataclass(frozen=True)
class FieldMap:
    """Columns of messages by expression, ids that must not be missing, and renamings of values."""

    columns: dict[str, str]
    required: tuple[str, ...] = ("message_id",)
    values: dict[str, dict[str, str]] = field(default_factory=dict)


def compile_expression(expression: str, v: str = "v") -> Column:
    """The column of an expression over the VARIANT column ``v``; ``null`` as default is none."""
    path, *steps = (s.strip() for s in expression.split("|"))
    if not re.fullmatch(r"\$(?:\.[A-Za-z_][\w-]*|\[\d+\])*", path):
        raise AdapterError(f"not a path: {path!r}")
    default = None
    if steps and steps[-1] not in FUNCTIONS:
        default = None if (last := steps.pop()) == "null" else last
    value = F.try_variant_get(F.col(v), path, "variant")
    if not steps or steps[0] not in FIRST:
        value = string(value)
    for k, s in enumerate(steps):
        if s not in FUNCTIONS or k and s in FIRST:
            raise AdapterError(f"unknown step {s!r} in {expression!r}")
        value = FUNCTIONS[s](value)
    return value if default is None else F.coalesce(value, F.lit(default))


def apply_map(records: DataFrame, mapping: FieldMap, v: str = "v") -> DataFrame:
    """``records`` with the mapped columns; rows that miss a required one are dropped."""
    out = records
    for name, expression in mapping.columns.items():
        c = compile_expression(expression, v)
        for old, new in mapping.values.get(name, {}).items():
            c = F.when(c == old, F.lit(new)).otherwise(c)
        out = out.withColumn(name, c)
    for name in mapping.required:
        out = out.where(F.col(name).isNotNull())
    return out


def monotonic_times(messages: DataFrame, order: str = "position") -> DataFrame:
    """Messages whose time is unknown take that of the one before in their thread (by ``order``), the first ones that of the next."""
    w = Window.partitionBy("conversation_id").orderBy(order)
    before = F.last("ts", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("ts", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return messages.withColumn("ts", F.coalesce(before, after))
