"""Normalisation: conversation VARIANTs to nodes, nodes to messages.

Every field is taken by its JSON type, so one odd value never fails a row: texts must be strings,
parts keep only their strings, timestamps may be numbers, numeric strings or booleans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.errors import AdapterError
from chatlake.functions.times import epoch_ms

Normalizer = Callable[[DataFrame], DataFrame]
_PROVIDERS: dict[str, Normalizer] = {}


def provider(name: str) -> Callable[[Normalizer], Normalizer]:
    """Register the normaliser of a provider: (source, line_no, v) in, message columns out."""

    def register(f: Normalizer) -> Normalizer:
        _PROVIDERS[name.lower()] = f
        return f

    return register


def normalizer(name: str = "openai") -> Normalizer:
    """The normaliser of a provider."""
    try:
        return _PROVIDERS[name.lower()]
    except KeyError:
        raise AdapterError(f"unknown provider: {name}") from None


def field(v: str, path: str) -> Column:
    """A field of a VARIANT column as VARIANT; null if it is not there."""
    return F.try_variant_get(F.col(v), path, "variant")


def is_object(x: Column) -> Column:
    """Whether a VARIANT is an object; a cast looks at its head only, where its schema would be built from all of it."""
    return F.try_variant_get(x, "$", "struct<_:variant>").isNotNull()


def is_array(x: Column) -> Column:
    """Whether a VARIANT is an array."""
    return F.try_variant_get(x, "$", "array<variant>").isNotNull()


def fields(x: Column, *names: str) -> Column:
    """A VARIANT object as a struct of the named fields (VARIANTs); null of anything else."""
    return F.try_variant_get(x, "$", "struct<" + ",".join(f"{n}:variant" for n in names) + ">")


def only_objects(rows: DataFrame, x: Column, names: tuple[str, ...], keep: list[Column | str]) -> DataFrame:
    """``keep`` and the named fields of the rows in which ``x`` is an object; each value is looked at once."""
    return rows.select(*keep, F.inline(F.array_compact(F.array(fields(x, *names)))))


def string(x: Column) -> Column:
    """A VARIANT that is a string, otherwise null."""
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def seconds(x: Column) -> Column:
    """A VARIANT as a number of seconds: numbers, numeric strings and booleans; null of anything else and of what counts as false."""
    kind = F.schema_of_variant(x)
    text = F.trim(F.try_variant_get(x, "$", "string"))
    number = F.when(kind == "STRING", F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))).when(kind.rlike("^(OBJECT|ARRAY|VOID)"), None).otherwise(F.try_variant_get(x, "$", "double"))
    return number


def truthy_seconds(first: Column, second: Column) -> Column:
    """Seconds of the first value, or of the second where the first is missing, zero or an empty string."""
    s = seconds(first)
    falsy = first.isNull() | F.is_variant_null(first) | F.coalesce(s == 0, F.lit(False)) | F.coalesce(string(first) == "", F.lit(False))
    return F.when(falsy, seconds(second)).otherwise(s)


def conversation_id(v: str = "v", source: Column | None = None) -> Column:
    """Id of a conversation: the first of conversation_id, id and uuid that counts as true, if it is a string; else the stem of the
    source's file name; without a source, twelve digits of the SHA-1 of title and time."""
    names = ["conversation_id", "id", "uuid"]

    def truthy(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        zero = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)") & (F.try_variant_get(x, "$", "double") == 0)
        return ~(x.isNull() | F.is_variant_null(x) | F.coalesce(string(x) == "", F.lit(False)) | F.coalesce(zero, F.lit(False)) | (kind == "BOOLEAN") & ~F.coalesce(F.try_variant_get(x, "$", "boolean"), F.lit(False)) | kind.isin("OBJECT<>", "ARRAY<VOID>"))

    chosen = None
    for n in reversed(names):
        x = field(v, f"$.{n}")
        chosen = F.when(truthy(x), F.coalesce(string(x), F.lit(""))) if chosen is None else F.when(truthy(x), F.coalesce(string(x), F.lit(""))).otherwise(chosen)
    title = F.coalesce(string(field(v, "$.title")), F.lit(""))
    made = F.coalesce(*(F.when(truthy(field(v, f"$.{n}")), F.try_variant_get(field(v, f"$.{n}"), "$", "string")) for n in ("create_time", "update_time")), F.lit(""))
    digest = F.substring(F.sha1(F.concat(title, F.lit("|"), made)), 1, 12)
    other = digest if source is None else F.coalesce(F.nullif(F.regexp_extract(source, r"([^/]+?)(?:\.[^./]*)?$", 1), F.lit("")), digest)
    return F.coalesce(F.nullif(chosen, F.lit("")), other)


def nodes(conversations: DataFrame, with_source: bool = True) -> DataFrame:
    """(conversation_id, node_id, node) of conversations (source, line_no, v): the objects of ``mapping``; other mappings give none."""
    rows = conversations.withColumn("conversation_id", conversation_id("v", F.col("source") if with_source else None)).withColumn("mapping", field("v", "$.mapping"))
    rows.where(is_object(F.col("mapping"))).select("conversation_id", "mapping").createOrReplaceTempView("_chatlake_mappings")
    out = conversations.sparkSession.sql("SELECT conversation_id, key AS node_id, value AS node FROM _chatlake_mappings, LATERAL variant_explode(mapping)")
    return out.where(is_object(F.col("node")))


#: Fields of a message that are read.
MESSAGE_FIELDS = ("id", "author", "role", "content", "create_time", "metadata")
_NO_STRINGS = "array<string>"


def message_rows(rows: DataFrame, message: Column) -> DataFrame:
    """Rows (conversation_id, node_id, parent, node_time) whose ``message`` is an object, with the columns of a normalised message.

    ``parent`` is a string, ``node_time`` the node's own time as VARIANT.
    """
    m = only_objects(rows, message, MESSAGE_FIELDS, ["conversation_id", "node_id", F.col("parent").alias("parent_id"), "node_time"])
    m = m.select(
        "conversation_id",
        "parent_id",
        F.coalesce(F.nullif(string(F.col("id")), F.lit("")), F.col("node_id")).alias("message_id"),
        fields(F.col("author"), "role")["role"].alias("author_role"),
        "role",
        epoch_ms(truthy_seconds(F.col("create_time"), F.col("node_time"))).alias("ts"),
        fields(F.col("content"), "content_type", "parts").alias("c"),
        string(fields(F.col("metadata"), "model_slug")["model_slug"]).alias("model"),
    )
    strings = F.filter(F.transform(F.try_variant_get(F.col("c.parts"), "$", "array<variant>"), string), lambda x: x.isNotNull())
    return m.select(
        "conversation_id",
        "message_id",
        "parent_id",
        F.coalesce(F.nullif(_first_truthy(F.col("author_role"), F.col("role")), F.lit("")), F.lit("unknown")).alias("role"),
        "ts",
        F.coalesce(string(F.col("c.content_type")), F.lit("text")).alias("content_type"),
        F.coalesce(strings, F.array().cast(_NO_STRINGS)).alias("parts"),
        "model",
    )


def finish(rows: DataFrame, provider_id: str) -> DataFrame:
    """Message rows of the canonical schema; rows without a time are dropped."""
    return rows.where("ts IS NOT NULL").select(
        F.lit(provider_id).alias("provider_id"),
        "conversation_id",
        "message_id",
        "parent_id",
        "role",
        "ts",
        F.struct("content_type", "parts").alias("content"),
        F.array_join("parts", "\n").alias("text"),
        F.when(F.col("model").isNotNull(), F.create_map(F.lit("model"), F.col("model"))).alias("meta"),
    )


@provider("openai")
def openai(conversations: DataFrame) -> DataFrame:
    """Messages of exported conversations: structural nodes and messages without a time are dropped."""
    rows = only_objects(nodes(conversations), F.col("node"), ("message", "parent", "create_time"), ["conversation_id", "node_id"])
    rows = rows.select("conversation_id", "node_id", "message", string(F.col("parent")).alias("parent"), F.col("create_time").alias("node_time"))
    return finish(message_rows(rows, F.col("message")), "openai")


def openai_nodes(mapping: DataFrame) -> DataFrame:
    """Messages of a table of nodes (conversation_id, node_id, parent, message as JSON text, create_time)."""
    node_time = F.try_variant_get(F.to_variant_object(F.struct(F.col("create_time").alias("t"))), "$.t", "variant")
    rows = mapping.select("conversation_id", "node_id", "parent", "message", node_time.alias("node_time"))
    return finish(message_rows(rows, F.try_parse_json("message")), "openai")


def _first_truthy(a: Column, b: Column) -> Column:
    """The first value if it counts as true, else the second; '' of what is no string."""
    falsy = a.isNull() | F.is_variant_null(a) | F.coalesce(string(a) == "", F.lit(False))
    return F.when(falsy, F.coalesce(string(b), F.lit(""))).otherwise(F.coalesce(string(a), F.lit("")))


@provider("claude")
@provider("gemini")
def flat(conversations: DataFrame) -> DataFrame:
    """Messages of conversations that hold a list of messages (``chat_messages`` or ``messages``) instead of a mapping."""
    rows = conversations.withColumn("conversation_id", conversation_id("v", F.col("source")))
    listed = F.coalesce(F.try_variant_get("v", "$.chat_messages", "array<variant>"), F.try_variant_get("v", "$.messages", "array<variant>"))
    rows = rows.select("conversation_id", F.posexplode(listed).alias("position", "m"))
    role = _first_truthy(field("m", "$.sender"), field("m", "$.role"))
    named = F.lower(F.trim(role))
    named = F.when(named == "human", "user").when(named.isin("model", "ai", "bot"), "assistant").otherwise(named)
    iso = F.unix_millis(F.try_to_timestamp(string(field("m", "$.created_at")))) / 1000.0
    columns = {
        "message_id": F.coalesce(F.nullif(string(field("m", "$.uuid")), F.lit("")), F.nullif(string(field("m", "$.id")), F.lit("")), F.concat_ws("-", "conversation_id", "position")),
        "parent_id": string(field("m", "$.parent_id")),
        "role": F.coalesce(F.nullif(named, F.lit("")), F.lit("unknown")),
        "ts": epoch_ms(F.coalesce(seconds(field("m", "$.create_time")), iso)),
        "content_type": F.lit("text"),
        "parts": F.filter(F.array(F.coalesce(string(field("m", "$.text")), string(field("m", "$.content")))), lambda x: x.isNotNull()),
        "model": string(field("m", "$.model")),
    }
    return finish(rows.select("conversation_id", *(c.alias(n) for n, c in columns.items())), "flat")


def manifest_defaults(provider_id: str) -> dict:
    """What a provider's normaliser declares of itself."""
    return {"schema_version": "1.2", "provider": provider_id, "id_fields": ["conversation_id", "message_id"], "expected_top_keys": ["mapping", "id", "create_time", "update_time"]}


def policy_defaults(provider_id: str) -> dict:
    """The policy that is copied to the manifest; its flags change nothing."""
    return {"keep_unicode_escape": True, "ignore_fields": ["metadata", "status", "recipient", "weight"], "flatten_parts_in_exporter": True, "allow_partial_parse": True, "timestamp_fields": ["create_time", "end_turn_time", "timestamp"], "safe_null_handling": True}


def flatten_parts(parts: Column, strict: bool = False) -> Column:
    """Text of an array of VARIANTs: strings and the ``text`` or ``delta`` of objects, sanitised and joined by a space.

    Others are written as JSON, or make the result null if ``strict``.
    """
    from chatlake.functions.text import sanitize

    def one(p: Column) -> Column:
        kind = F.schema_of_variant(p)
        inner = F.coalesce(*(F.nullif(string(F.try_variant_get(p, f"$.{n}", "variant")), F.lit("")) for n in ("text", "delta")))
        text = F.when(kind == "STRING", string(p)).when(is_object(p), inner)
        return text if strict else F.coalesce(text, F.to_json(p))

    texts = F.transform(parts, one)
    joined = F.array_join(F.transform(texts, sanitize), " ")
    return F.when(~F.exists(texts, lambda t: t.isNull()), joined) if strict else joined


def content_text(content: Column) -> Column:
    """The most readable text of a content VARIANT: a string, its parts, its text, its data, or its JSON; '' of null."""
    from chatlake.functions.text import sanitize

    kind = F.schema_of_variant(content)
    sub = lambda n: F.try_variant_get(content, f"$.{n}", "variant")
    scalar = lambda x: F.coalesce(string(x), F.to_json(x))
    parts = F.try_variant_get(content, "$.parts", "array<variant>")
    return (
        F.when(content.isNull() | F.is_variant_null(content), F.lit(""))
        .when(kind == "STRING", sanitize(string(content)))
        .when(is_array(sub("parts")), flatten_parts(parts))
        .when(sub("text").isNotNull(), sanitize(scalar(sub("text"))))
        .when(sub("data").isNotNull(), sanitize(scalar(sub("data"))))
        .otherwise(sanitize(F.to_json(content)))
    )


def preferred(content: Column, keys: tuple[str, ...]) -> Column:
    """The first of ``keys`` that an object has as string, array or object; otherwise the content itself."""
    out = content
    for k in reversed(keys):
        sub = F.try_variant_get(content, f"$.{k}", "variant")
        out = F.when(string(sub).isNotNull() | is_array(sub) | is_object(sub), sub).otherwise(out)
    return out


def normalize_text(content: Column, keys: tuple[str, ...] = (), loose: bool = True) -> Column:
    """Text of a content VARIANT after ``preferred``; strict flattening that fails falls back to ``content_text``."""
    from chatlake.functions.text import sanitize

    c = preferred(content, keys)
    kind = F.schema_of_variant(c)
    listed = F.when(is_array(c), F.try_variant_get(c, "$", "array<variant>")).when(is_array(F.try_variant_get(c, "$.parts", "variant")), F.try_variant_get(c, "$.parts", "array<variant>"))
    return F.coalesce(F.when(kind == "STRING", sanitize(string(c))), flatten_parts(listed, strict=not loose), content_text(c))


def normalize_structure(content: Column, keys: tuple[str, ...] = ()) -> Column:
    """Content as struct<content_type, parts>: an object's own, or a text of one part; parts that are no strings are JSON."""
    c = preferred(content, keys)
    kind = F.schema_of_variant(c)
    has_parts = F.coalesce(is_array(F.try_variant_get(c, "$.parts", "variant")), F.lit(False))
    listed = F.when(is_array(c), F.try_variant_get(c, "$", "array<variant>")).when(has_parts, F.try_variant_get(c, "$.parts", "array<variant>")).otherwise(F.array(c))
    parts = F.transform(listed, lambda p: F.coalesce(string(p), F.to_json(p)))
    return F.struct(F.coalesce(F.when(has_parts, string(F.try_variant_get(c, "$.content_type", "variant"))), F.lit("text")).alias("content_type"), parts.alias("parts"))
