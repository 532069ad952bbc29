"""Validation of messages, parsed lines and manifests, as rule tables over columns."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib import resources
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.errors import ValidationError
from chatlake.operators.normalize import is_array, is_object

#: Reasons of the quick check, in the order in which they are looked for.
REASONS = ("conversation_id", "message_id", "role", "ts", "content", "content.content_type", "content.parts", "text")


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c) == "", F.lit(True))


def rules() -> dict[str, Column]:
    """Reason -> what makes a typed message row invalid."""
    return {
        "conversation_id": _empty("conversation_id"),
        "message_id": _empty("message_id"),
        "role": _empty("role"),
        "ts": F.col("ts").isNull(),
        "content": F.col("content").isNull(),
        "content.content_type": F.col("content").isNotNull() & _empty("content.content_type"),
        "content.parts": F.col("content").isNotNull() & (F.col("content.parts").isNull() | F.exists("content.parts", lambda p: p.isNull())),
        "text": F.col("text").isNull(),
    }


def with_reasons(messages: DataFrame) -> DataFrame:
    """Messages with ``reasons``, the failed rules in order, and ``valid``."""
    failed = F.array_compact(F.array(*(F.when(bad, F.lit(reason)) for reason, bad in rules().items())))
    return messages.withColumn("reasons", failed).withColumn("valid", F.size("reasons") == 0)


def fail_fast(messages: DataFrame) -> DataFrame:
    """Messages that raise when an invalid one is read."""
    m = with_reasons(messages)
    check = F.when(F.col("valid"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("missing or invalid field: "), F.element_at("reasons", 1))).cast("boolean"))
    return m.withColumn("valid", check).drop("reasons")


# JSON Schema: records as VARIANT, so that types count.

#: JSON type -> what ``schema_of_variant`` says of it.
_KINDS = {"string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "boolean": "^BOOLEAN$", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"}


def schema_file(name: str) -> dict:
    """A schema of the package: ``message`` or ``manifest``."""
    return json.loads(resources.files("chatlake").joinpath("schema_files", f"{name}.json").read_text("utf-8"))


def load_schema(name_or_path: str) -> dict:
    p = Path(name_or_path)
    return json.loads(p.read_text("utf-8")) if p.suffix == ".json" else schema_file(name_or_path)


def schema_rules(schema: dict, v: str = "v", path: str = "") -> list[tuple[str, str, Column]]:
    """(field path, message, violated) of a JSON Schema, for the keywords our schemas use, on a VARIANT column.

    type, required, properties, additionalProperties, const, enum, minLength, minimum and items of one type.
    """
    out: list[tuple[str, str, Column]] = []
    here = F.try_variant_get(F.col(v), "$" + (f".{path}" if path else ""), "variant")
    kind = F.schema_of_variant(here)
    present = here.isNotNull()
    label = path or "<root>"
    fits = F.lit(True)
    if "type" in schema:
        types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        fits = F.lit(False)
        for t in types:
            # Objects and arrays are told by a cast: the schema of a large value is built from all of it.
            own = is_object(here) if t == "object" else is_array(here) if t == "array" else F.coalesce(kind.rlike(_KINDS.get(t, "^VOID$")), F.lit(False))
            fits = fits | own
        out.append((label, f"is not of type {', '.join(map(repr, types))}", present & ~fits))
    text = F.try_variant_get(here, "$", "string")
    if "const" in schema:
        out.append((label, f"{schema['const']!r} was expected", present & F.coalesce((kind != "STRING") | (text != schema["const"]), F.lit(True))))
    if "enum" in schema:
        out.append((label, f"is not one of {schema['enum']!r}", present & ~F.coalesce(text.isin(*map(str, schema["enum"])), F.lit(False))))
    if "minLength" in schema:
        out.append((label, "is too short", present & (kind == "STRING") & (F.length(text) < schema["minLength"])))
    if "minimum" in schema:
        out.append((label, f"is less than the minimum of {schema['minimum']}", present & F.coalesce(F.try_variant_get(here, "$", "double") < schema["minimum"], F.lit(False))))
    if schema.get("type") == "object" or "properties" in schema:
        for name in schema.get("required", []):
            sub = F.try_variant_get(F.col(v), "$" + (f".{path}" if path else "") + f".{name}", "variant")
            out.append((label, f"{name!r} is a required property", present & fits & sub.isNull()))
        for name, sub in schema.get("properties", {}).items():
            out += schema_rules(sub, v, f"{path}.{name}" if path else name)
        if schema.get("additionalProperties") is False:
            known = F.array(*(F.lit(n) for n in schema.get("properties", {})))
            keys = F.map_keys(F.try_variant_get(here, "$", "map<string,variant>"))
            out.append((label, "additional properties are not allowed", present & fits & F.coalesce(F.size(F.array_except(keys, known)) > 0, F.lit(False))))
    if "items" in schema and isinstance(schema["items"].get("type"), str):
        bad = F.exists(F.try_variant_get(here, "$", "array<variant>"), lambda x: ~F.coalesce(F.schema_of_variant(x).rlike(_KINDS.get(schema["items"]["type"], "^" + schema["items"]["type"].upper())), F.lit(False)))
        out.append((label, f"has items that are not of type {schema['items']['type']!r}", present & F.coalesce(bad, F.lit(False))))
    return out


def violations(records: DataFrame, schema: dict, path: str = "path", line_no: str = "line_no") -> DataFrame:
    """(path, line_no, field_path, message): each violated rule of each record (path, line_no, v); a null v is no JSON."""
    found = [F.when(F.col("v").isNull(), F.struct(F.lit(0).alias("rule"), F.lit("<root>").alias("field_path"), F.lit("is not valid JSON").alias("message")))]
    for k, (where, message, bad) in enumerate(schema_rules(schema), 1):
        found.append(F.when(bad, F.struct(F.lit(k).alias("rule"), F.lit(where).alias("field_path"), F.lit(message).alias("message"))))
    rows = records.select(F.col(path).alias("path"), F.col(line_no).alias("line_no"), F.explode(F.array_compact(F.array(*found))).alias("x"))
    return rows.select("path", "line_no", "x.rule", "x.field_path", "x.message")


def first_violation(found: DataFrame) -> DataFrame:
    """The first violated rule of each record."""
    return found.groupBy("path", "line_no").agg(F.min_by(F.struct("field_path", "message"), "rule").alias("x")).select("path", "line_no", "x.*")


def numbered_lines(spark, path: str) -> DataFrame:
    """(path, line_no, raw, v) of the lines of files, numbered from 1; files are taken whole, blank lines keep their number but give no row."""
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    lines = whole.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("n", "raw"))
    return lines.where(F.length(F.trim("raw")) > 0).select("path", (F.col("n") + 1).cast("bigint").alias("line_no"), "raw", F.try_parse_json("raw").alias("v"))


@dataclass
class Summary:
    """Outcome of validating one file."""

    path: str
    ok: bool
    violations: list[dict] = field(default_factory=list)

    def raise_if_failed(self) -> None:
        if not self.ok:
            raise ValidationError("\n".join([f"{self.path}: {len(self.violations)} violations", *(f"  line {v['line_no']}: {v['field_path']}: {v['message']}" for v in self.violations)]))


def validate_parsed(spark, path: str, stop_on_first_error: bool = False, route: bool = True) -> DataFrame:
    """Violations of parsed.jsonl files; with ``route`` only message lines are held against the message schema."""
    lines = numbered_lines(spark, path)
    if route:
        lines = lines.where(F.col("v").isNull() | ~F.coalesce(F.try_variant_get("v", "$.record_type", "string") == "thread", F.lit(False)))
    found = violations(lines, schema_file("message"))
    if stop_on_first_error:
        # Of each file, in order of lines and rules.
        w = Window.partitionBy("path").orderBy("line_no", "rule")
        found = found.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return found


def validate_manifest(spark, path: str) -> Summary:
    """Outcome for one manifest, a small file."""
    rows = spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.lit(1).cast("bigint").alias("line_no"), F.try_parse_json("value").alias("v"))
    found = [r.asDict() for r in violations(rows, schema_file("manifest")).orderBy("rule").collect()]
    return Summary(path, not found, found)


Checker = Callable[[DataFrame], DataFrame]
