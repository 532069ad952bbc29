"""Problem 4: schemas that drift between files.

Method: rescue-column ingestion. Every line is read against a target schema; what the schema
does not know, or what does not cast, is kept in a rescue column by its path. Fields that are
approved under another name are promoted and the rescued values replayed into the typed columns.
The change report compares the fields of each file, typed or rescued, with those of the file
before it in its stream; it reads the same rescued lines as the table, so each line is parsed once.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.session import broadcast_if_small, materialize


@dataclass(frozen=True)
class Target:
    """The enforced schema: column -> (path, type); ``approved`` gives further paths that may fill a column."""

    columns: dict[str, tuple[str, str]]
    approved: dict[str, tuple[str, ...]] = field(default_factory=dict)


#: Node and manifest records as the current export writes them; types: string, double, boolean, strings (an array).
RECORDS = Target(
    {
        "id": ("id", "string"),
        "conversation_id": ("conversation_id", "string"),
        "create_time": ("message.create_time", "double"),
        "role": ("message.author.role", "string"),
        "content_type": ("message.content.content_type", "string"),
        "parts": ("message.content.parts", "strings"),
        "status": ("message.status", "string"),
        "weight": ("message.weight", "double"),
        "end_turn": ("message.end_turn", "boolean"),
        "model_slug": ("message.model_slug", "string"),
        "recipient": ("message.recipient", "string"),
        "schema_version": ("schema_version", "string"),
        "provider": ("provider", "string"),
        "exported_at": ("exported_at", "string"),
    }
)

_SPARK_TYPES = {"string": "string", "double": "double", "boolean": "boolean", "strings": "array<string>"}


def kind_of(value) -> str | None:
    """Type of a JSON value: string, number, boolean, object, or array with the set of its elements' types; None of a null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        return "object"
    return "array<" + ",".join(sorted({k for v in value if (k := kind_of(v))})) + ">"


_quoted = json.encoder.encode_basestring


def _plain(value):
    """A value in which equal JSON values are equal texts: whole floats become integers."""
    if isinstance(value, float) and not isinstance(value, bool) and math.isfinite(value) and value == int(value):
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def canonical(value) -> str:
    """JSON text of a value; equal values have equal texts."""
    if value is None:
        return "null"
    if isinstance(value, str):
        return _quoted(value)
    if value is True or value is False:
        return "true" if value else "false"
    return json.dumps(_plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def fields_of(record: dict) -> list[tuple[str, object]]:
    """(dotted path, value) of each field through objects, not into arrays; parents come first."""
    out, todo = [], [("", record)]
    while todo:
        prefix, obj = todo.pop(0)
        for key, value in obj.items():
            path = prefix + key
            out.append((path, value))
            if isinstance(value, dict):
                todo.append((path + ".", value))
    return out


def cast(value, kind: str):
    """``value`` as the target type, or None if it does not cast without loss."""
    if kind == "string":
        return value if isinstance(value, str) else None
    if kind == "double":
        if isinstance(value, bool):
            return None
        try:
            x = float(value) if isinstance(value, (int, float, str)) and not (isinstance(value, str) and "_" in value) else None
        except (ValueError, OverflowError):
            return None
        return x if x is not None and math.isfinite(x) else None
    if kind == "boolean":
        return value if isinstance(value, bool) else {"true": True, "false": False}.get(value) if isinstance(value, str) else None
    if isinstance(value, str):
        return value.split("\n")
    return value if isinstance(value, list) and all(isinstance(v, str) for v in value) else None


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def record_of(text: str | None) -> dict | None:
    """The object of a line, or None if it is none."""
    try:
        record = json.loads(text, parse_constant=_refuse)
    except (ValueError, TypeError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def paths_of(target: Target) -> dict[str, tuple[str, str]]:
    """Path -> (column, type), the approved paths after the columns' own."""
    by_path = {p: (c, k) for c, (p, k) in target.columns.items()}
    for column, paths in target.approved.items():
        for p in paths:
            by_path.setdefault(p, (column, target.columns[column][1]))
    return by_path


def enforce(record: dict, by_path: dict[str, tuple[str, str]]) -> tuple[dict, dict[str, str], dict[str, str], list[tuple[str, str | None]]]:
    """Column values of a record, the JSON texts they came from by path, the rescued fields by path, and the record's shape."""
    filled, typed, rescued, shape = {}, {}, {}, []
    for path, value in fields_of(record):
        shape.append((path, kind_of(value)))
        to = by_path.get(path)
        got = cast(value, to[1]) if to else None
        if got is not None and to[0] not in filled:
            filled[to[0]] = got
            typed[path] = canonical(value)
        elif not isinstance(value, dict) or not value:
            rescued[path] = canonical(value)
    return filled, typed, rescued, shape


def rescue(raw: DataFrame, target: Target = RECORDS) -> DataFrame:
    """Each line of ``raw`` (file_id, line_no, record_kind, raw) once more as typed columns and ``rescued``.

    ``rescued`` maps the path of every field that fills no column - unknown, or not castable - to its JSON text; objects are
    taken apart. ``typed`` maps the paths that fill columns to the JSON they came from. ``shape`` is a JSON array of
    the line's fields, objects included, with their types, as far as no line before it in the same task and file showed them, so
    the shapes of a file are together its fields; null if it has none. Lines that are not a JSON object have ``valid``
    false and nothing else. Repeated lines stay repeated.
    """
    names = list(target.columns)
    schema = "file_id bigint, line_no int, record_kind string, valid boolean, " + ", ".join(f"{c} {_SPARK_TYPES[k]}" for c, (_, k) in target.columns.items()) + ", typed map<string,string>, rescued map<string,string>, shape string"
    arrow = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "strings": pa.list_(pa.string())}
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.bool_(), *(arrow[k] for _, k in target.columns.values()), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.string()), pa.string()]
    by_path = paths_of(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, set] = {}  # fields of the files of this task
        for batch in batches:
            rows = []
            for file_id, line_no, kind, text in zip(*(c.to_pylist() for c in batch.columns)):
                record = record_of(text)
                valid = record is not None
                filled, typed, rescued, shape = enforce(record, by_path) if valid else ({}, {}, {}, [])
                known = seen.setdefault((file_id, kind), set())
                fresh = [f for f in shape if f not in known]
                known.update(fresh)
                shape = json.dumps(fresh, ensure_ascii=False) if fresh else None
                rows.append([file_id, line_no, kind, valid, *(filled.get(n) for n in names), list(typed.items()), list(rescued.items()), shape])
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["file_id", "line_no", "record_kind", "valid", *names, "typed", "rescued", "shape"])

    return raw.select(F.col("file_id").cast("bigint"), F.col("line_no").cast("int"), "record_kind", "raw").mapInArrow(run, schema)


def _other_than(path: str):
    return lambda k, v: k != F.lit(path)


def replay(rescued: DataFrame, approved: dict[str, tuple[str, ...]], target: Target = RECORDS) -> DataFrame:
    """Promote fields: where a column is null, the first approved path with a castable rescued value fills it and leaves ``rescued``."""
    out = rescued
    for column, paths in approved.items():
        kind = target.columns[column][1]
        for path in paths:
            text = F.col("rescued")[path]
            value = {
                "string": F.when(text.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"]),
                "double": F.expr("try_cast(trim(both '\"' from rescued[:p]) as double)".replace(":p", "'" + path.replace("'", "\\'") + "'")),
                "boolean": F.expr("try_cast(trim(both '\"' from rescued[:p]) as boolean)".replace(":p", "'" + path.replace("'", "\\'") + "'")),
                "strings": F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.startswith('"'), F.split(F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"], "\n")),
            }[kind]
            take = F.col(column).isNull() & value.isNotNull()
            out = out.withColumns(
                {
                    column: F.when(take, value).otherwise(F.col(column)),
                    "rescued": F.when(take, F.map_filter("rescued", _other_than(path))).otherwise(F.col("rescued")),
                }
            )
    return out


def _value_of(fields: str, name: str) -> Column:
    """(name, value) of each of the record's fields in the array column ``fields``: a hash of its JSON text, of an object's of what is below it; nulls left out."""
    entries = F.concat(F.map_entries("typed"), F.map_entries("rescued"))  # a path may be in both where keys hold dots

    def one(f):
        below = F.filter(entries, lambda e: F.startswith(e["key"], F.concat(f, F.lit("."))))
        inside = F.array_sort(F.transform(below, lambda e: F.concat(F.substr(e["key"], F.length(f) + 2), F.lit(":"), e["value"])))
        text = F.coalesce(F.try_element_at("typed", f), F.try_element_at("rescued", f), F.when(F.size(below) > 0, F.concat(F.lit("{"), F.array_join(inside, ","))))
        return F.struct(f.alias(name), F.when(text != "null", F.xxhash64(text)).alias("value"))

    return F.explode(F.filter(F.transform(fields, one), lambda x: x["value"].isNotNull()))


def file_pairs(manifest: DataFrame) -> DataFrame:
    """(file_id, old_id): each file and the one before it in its stream by exported_at, then file_id."""
    w = Window.partitionBy("stream_id").orderBy("exported_at", "file_id")
    return manifest.select("stream_id", "exported_at", "file_id").distinct().withColumn("old_id", F.lag("file_id").over(w)).where("old_id IS NOT NULL").select("file_id", "old_id")


def changes_of(lines: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file_id, record_kind, change, field, new_field): what changed in each file against the one before it in its stream.

    ``lines`` are rescued lines (see ``rescue``), best materialised; what their typed and rescued fields are is the report.
    ``type_changed``, ``renamed``, ``removed`` and ``added`` as the lines show it; fields below a reported one are left
    out. Invalid lines count for nothing; a kind of record that only one of the two files has counts as its fields being
    added or removed. Files that the manifest does not name are left out.
    """
    lines = lines.where("valid")
    fields = lines.where("shape IS NOT NULL").select("file_id", "record_kind", F.explode(F.from_json("shape", "array<array<string>>")).alias("f"))
    kinds = fields.groupBy("file_id", "record_kind", F.col("f")[0].alias("field")).agg(F.array_sort(F.collect_set(F.col("f")[1])).alias("kinds"))
    kinds = materialize(kinds, "kinds")
    pairs = file_pairs(manifest)
    new = kinds.join(pairs, "file_id").withColumnRenamed("kinds", "new_kinds")
    old = kinds.withColumnRenamed("file_id", "old_id").withColumnRenamed("kinds", "old_kinds").join(pairs, "old_id")
    both = materialize(new.join(old, ["file_id", "old_id", "record_kind", "field"], "full"), "compared")
    key = ["file_id", "old_id", "record_kind"]
    typed = both.where("size(old_kinds) > 0 AND size(new_kinds) > 0 AND old_kinds <> new_kinds").select("file_id", "record_kind", F.lit("type_changed").alias("change"), "field", F.lit("").alias("new_field"))
    gone = both.where("new_kinds IS NULL").select(*key, "field")
    came = both.where("old_kinds IS NULL").select(*key, F.col("field").alias("new_field"))
    # Values of the fields in question only, where one may be the other, joined by record; a manifest record has no id.
    lost = both.where("new_kinds IS NULL").groupBy(*key).agg(F.collect_list("field").alias("fields"))
    won = both.where("old_kinds IS NULL").groupBy(*key).agg(F.collect_list("field").alias("new_fields"))
    asked = lost.join(won, key)
    record = F.when(F.col("record_kind") == "manifest", F.lit("")).otherwise(F.col("id")).alias("id")
    values = lines.select("file_id", "record_kind", record, "typed", "rescued").where("id IS NOT NULL")
    was = values.withColumnRenamed("file_id", "old_id").join(broadcast_if_small(asked.drop("new_fields")), ["old_id", "record_kind"]).select(*key, "id", _value_of("fields", "field").alias("v"))
    now = values.join(broadcast_if_small(asked.drop("fields")), ["file_id", "record_kind"]).select(*key, "id", _value_of("new_fields", "new_field").alias("v"))
    was = was.select(*key, "id", "v.field", "v.value").distinct()
    now = now.select(*key, "id", "v.new_field", F.col("v.value").alias("new_value")).distinct()
    same = was.join(now, [*key, "id"]).groupBy(*key, "field", "new_field").agg(F.min((F.col("value") == F.col("new_value")).cast("int")).alias("equal")).where("equal = 1")
    same = materialize(same, "renames")
    renamed = same.select("file_id", "record_kind", F.lit("renamed").alias("change"), "field", "new_field")
    removed = gone.join(same, [*key, "field"], "left_anti").select("file_id", "record_kind", F.lit("removed").alias("change"), "field", F.lit("").alias("new_field"))
    added = came.join(same, [*key, "new_field"], "left_anti").select("file_id", "record_kind", F.lit("added").alias("change"), F.col("new_field").alias("field"), F.lit("").alias("new_field"))
    found = materialize(typed.unionByName(renamed).unionByName(removed).unionByName(added), "changes")
    # A report is dropped if a field above it is reported for the same file, under the old or the new name.
    reported = found.select("file_id", "record_kind", "field").unionByName(found.where("change = 'renamed'").select("file_id", "record_kind", F.col("new_field").alias("field"))).distinct()
    above = reported.withColumnRenamed("field", "above")

    def over(column: str):
        steps = F.split(column, r"\.")
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda k: F.array_join(F.slice(steps, 1, k), "."))

    names = F.array_distinct(F.concat(over("field"), F.when(F.col("change") == "renamed", over("new_field")).otherwise(F.array().cast("array<string>"))))
    below = found.withColumn("above", F.explode(F.filter(names, lambda x: (x != F.col("field")) & (x != F.col("new_field")))))
    below = below.join(above, ["file_id", "record_kind", "above"], "left_semi").select(*found.columns).distinct()
    return found.join(below, found.columns, "left_anti")


def schema_changes(raw: DataFrame, manifest: DataFrame, target: Target = RECORDS) -> DataFrame:
    """``changes_of`` raw lines (file_id, line_no, record_kind, raw), each rescued once."""
    return changes_of(materialize(rescue(raw, target), "rescued"), manifest)


def renames(changes: DataFrame, target: Target = RECORDS) -> dict[str, tuple[str, ...]]:
    """Column -> other names its path was seen to take: the promotions that a change report approves.

    The report has at most a few rows per file; only its distinct names reach the driver.
    """
    pairs = changes.where("change = 'renamed'").select("field", "new_field").distinct().collect()
    to: dict[str, set[str]] = {}
    for r in pairs:
        to.setdefault(r["field"], set()).add(r["new_field"])
        to.setdefault(r["new_field"], set()).add(r["field"])
    # A chain in which each rename is taken once lengthens a path by so many steps at most; circles of renames end there.
    longer = sum(abs(r["field"].count(".") - r["new_field"].count(".")) for r in pairs)
    out = {}
    for column, (path, _) in target.columns.items():
        names, todo = {path}, [path]
        while todo:
            steps = todo.pop().split(".")
            # A rename of an object renames the paths below it.
            for k in range(1, len(steps) + 1):
                for b in to.get(".".join(steps[:k]), ()):
                    other = ".".join([b, *steps[k:]])
                    if other not in names and other.count(".") <= path.count(".") + longer:
                        names.add(other)
                        todo.append(other)
        if len(names) > 1:
            out[column] = tuple(sorted(names - {path}))
    return out


def unified(raw: DataFrame, manifest: DataFrame, target: Target = RECORDS) -> DataFrame:
    """All lines in one table of typed columns: renamed fields are promoted and their rescued values replayed."""
    lines = materialize(rescue(raw, target), "rescued")
    return replay(lines.where("valid"), renames(changes_of(lines, manifest), target), target)
