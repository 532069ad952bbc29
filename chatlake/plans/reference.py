"""Queries of the thread operators: normalising, validating, indexing, rendering, splitting, incremental runs.

Each is one entry with its SQL beside it. ``mapping`` holds exported nodes, ``parsed`` thread lines, ``manifest`` the files;
all queries read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.functions import sizes, text, times
from chatlake.operators import fieldmap, incremental, normalize, render, split, threads, tree, validate
from chatlake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# What several queries read.


def nodes(spark, d) -> DataFrame:
    """Each node once, as its latest copy has it."""
    rows = table(spark, d, "mapping").where("conversation_id IS NOT NULL AND node_id IS NOT NULL").select("conversation_id", "node_id", "parent", "children", "message", "create_time", "ingested_at", "file_id")
    rows = rows.withColumn("_n", F.coalesce(F.size("children"), F.lit(-1)))
    best = threads.latest_rows(rows, ["conversation_id", "node_id"], ["ingested_at", "file_id", "_n", "message"])
    return best.drop("_n", "ingested_at", "file_id")


NODES = """nodes AS (
  SELECT conversation_id, node_id, parent, children, message, create_time FROM (
    SELECT *, row_number() OVER (PARTITION BY conversation_id, node_id ORDER BY ingested_at DESC NULLS LAST, file_id DESC NULLS LAST, coalesce(len(children), -1) DESC, message DESC NULLS LAST) AS rn
    FROM mapping WHERE conversation_id IS NOT NULL AND node_id IS NOT NULL) WHERE rn = 1)"""

JSON = NODES + """, js AS (
  SELECT *, CASE WHEN json_valid(message) THEN CAST(message AS JSON) END AS j FROM nodes WHERE json_valid(message) AND json_type(message) = 'OBJECT')"""

MESSAGES = JSON + """, raw AS (
  SELECT conversation_id,
    coalesce(nullif(CASE WHEN json_type(j, '$.id') = 'VARCHAR' THEN json_extract_string(j, '$.id') END, ''), node_id) AS message_id,
    parent AS parent_id,
    coalesce(nullif(coalesce(nullif(CASE WHEN json_type(j, '$.author.role') = 'VARCHAR' THEN json_extract_string(j, '$.author.role') END, ''), CASE WHEN json_type(j, '$.role') = 'VARCHAR' THEN json_extract_string(j, '$.role') END), ''), 'unknown') AS role,
    CAST(trunc(coalesce(nullif(TRY_CAST(json_extract_string(j, '$.create_time') AS DOUBLE), 0), create_time) * 1000) AS BIGINT) AS ts,
    coalesce(CASE WHEN json_type(j, '$.content.content_type') = 'VARCHAR' THEN json_extract_string(j, '$.content.content_type') END, 'text') AS content_type,
    CASE WHEN json_type(j, '$.content.parts') = 'ARRAY' THEN list_transform(list_filter(json_extract(j, '$.content.parts[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$') ELSE [] END AS parts,
    CASE WHEN json_type(j, '$.metadata.model_slug') = 'VARCHAR' THEN json_extract_string(j, '$.metadata.model_slug') END AS model
  FROM js), msgs AS (SELECT *, array_to_string(parts, chr(10)) AS text FROM raw WHERE ts IS NOT NULL)"""


def messages(spark, d) -> DataFrame:
    """Normalised messages of the exported nodes."""
    return normalize.openai_nodes(nodes(spark, d))


def parsed(spark, d) -> DataFrame:
    """The message lines of parsed threads, copies once."""
    rows = table(spark, d, "parsed").where("record_type = 'message' AND conversation_id IS NOT NULL")
    return threads.dedupe_messages(rows.select("provider_id", "conversation_id", "message_id", "parent_id", "role", "ts", "content", "text", "meta"))


PARSED = """pm AS (
  SELECT provider_id, conversation_id, message_id, parent_id, role, ts, content, text, meta FROM (
    SELECT *, row_number() OVER (PARTITION BY provider_id, conversation_id, message_id ORDER BY ts NULLS FIRST, text NULLS FIRST) AS rn
    FROM parsed WHERE record_type = 'message' AND conversation_id IS NOT NULL) WHERE rn = 1)"""

WHITE = r"[\s\p{Z}\x1c-\x1f\x85]"
MS = "(CASE WHEN ts >= 100000000000 THEN ts ELSE ts * 1000 END)"
ISO = (
    "coalesce(CASE WHEN {ms} % 1000 = 0 THEN strftime(make_timestamp({ms} * 1000), '%Y-%m-%dT%H:%M:%S+00:00') ELSE strftime(make_timestamp({ms} * 1000), '%Y-%m-%dT%H:%M:%S.%f+00:00') END, '')"
)


def iso_sql(c: str) -> str:
    return ISO.format(ms=MS.replace("ts", c))


def light_sql(source: str, key: str) -> str:
    """CTEs that give (key, out) of the light format of (key, text) rows."""
    return f"""lines AS (
  SELECT {key}, CASE WHEN text = '' THEN [] WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM (
    SELECT {key}, text, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM {source})),
ex AS (SELECT {key}, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM lines),
f AS (SELECT *, regexp_matches(x, '^{WHITE}*```') AS fence FROM ex),
g AS (SELECT *, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fb, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY {key}) AS ft FROM f),
h AS (SELECT *, (NOT fence AND coalesce(fb, 0) % 2 = 0 AND regexp_matches(x, '^{WHITE}*$')) AS blank FROM g),
k AS (SELECT *, lag(blank, 1, false) OVER (PARTITION BY {key} ORDER BY i) AS pb FROM h),
lf AS (SELECT {key}, regexp_replace(string_agg(CASE WHEN blank THEN '' ELSE x END, chr(10) ORDER BY i) || CASE WHEN max(ft) % 2 = 1 THEN chr(10) || '```' ELSE '' END, '\\n+$', '') AS out FROM k WHERE NOT (blank AND pb) GROUP BY {key})"""


# Scans.


@query("SELECT file_id, count(*) AS lines, CAST(sum(CASE WHEN json_valid(raw) THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN json_valid(raw) THEN 0 ELSE 1 END) AS BIGINT) AS dropped FROM raw_records GROUP BY file_id")
def scan_lines(spark, d):
    ok = F.try_parse_json("raw").isNotNull()
    return table(spark, d, "raw_records").groupBy("file_id").agg(F.count("*").alias("lines"), F.sum(ok.cast("bigint")).alias("kept"), F.sum((~ok).cast("bigint")).alias("dropped"))


@query("SELECT file_id, line_no, raw FROM raw_records WHERE NOT json_valid(raw) ORDER BY file_id, line_no, raw LIMIT 5")
def error_samples_top5(spark, d):
    bad = table(spark, d, "raw_records").where(F.try_parse_json("raw").isNull())
    return bad.orderBy("file_id", "line_no", "raw").limit(5).select("file_id", "line_no", "raw")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(len(json_keys(props)) AS BIGINT) AS n_keys FROM events WHERE json_valid(props)")
def events_jsonl_props(spark, d):
    v = table(spark, d, "events").withColumn("v", F.try_parse_json("props")).where("v IS NOT NULL")
    return v.select("event_id", F.try_variant_get("v", "$.k", "string").alias("k"), F.size(F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))).cast("bigint").alias("n_keys"))


# Projections.


@query(f"WITH {MESSAGES} SELECT conversation_id, message_id, parent_id, role, ts, content_type, CAST(len(parts) AS BIGINT) AS n_parts, text, model FROM msgs")
def normalize_messages(spark, d):
    m = messages(spark, d)
    return m.select("conversation_id", "message_id", "parent_id", "role", "ts", "content.content_type", F.size("content.parts").cast("bigint").alias("n_parts"), "text", F.col("meta")["model"].alias("model"))


@query(f"WITH {NODES} SELECT conversation_id, node_id FROM nodes WHERE message IS NULL OR NOT json_valid(message) OR json_type(message) <> 'OBJECT'")
def structural_nodes(spark, d):
    v = nodes(spark, d).withColumn("v", F.try_parse_json("message"))
    return v.where(~normalize.is_object(F.col("v"))).select("conversation_id", "node_id")


@query(f"WITH {MESSAGES} SELECT message_id, array_to_string(parts, '|') AS parts, text FROM msgs WHERE len(parts) <> 1")
def parts_filter_join(spark, d):
    m = messages(spark, d).where(F.size("content.parts") != 1)
    return m.select("message_id", F.array_join("content.parts", "|").alias("parts"), "text")


@query(f"WITH {MESSAGES} SELECT role, count(*) AS n FROM msgs GROUP BY role")
def role_default(spark, d):
    return messages(spark, d).groupBy("role").agg(F.count("*").alias("n"))


@query(f"WITH {MESSAGES} SELECT conversation_id, message_id, ts FROM msgs")
def epoch_ms(spark, d):
    return messages(spark, d).select("conversation_id", "message_id", "ts")


@query(
    """WITH r AS (SELECT file_id, line_no, CAST(raw AS JSON) AS j FROM raw_records WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'),
    c AS (SELECT *, [json_type(j, '$.' || n) FOR n IN ['conversation_id', 'id', 'uuid']] AS t, [json_extract_string(j, '$.' || n) FOR n IN ['conversation_id', 'id', 'uuid']] AS s FROM r)
    SELECT file_id, line_no, CASE WHEN t[1] = 'VARCHAR' AND s[1] <> '' THEN s[1] WHEN t[2] = 'VARCHAR' AND s[2] <> '' THEN s[2] WHEN t[3] = 'VARCHAR' AND s[3] <> '' THEN s[3] ELSE 'file-' || file_id END AS cid FROM c"""
)
def derive_conversation_id(spark, d):
    rows = table(spark, d, "raw_records").withColumn("v", F.try_parse_json("raw")).where(normalize.is_object(F.col("v")))
    source = F.concat(F.lit("/exports/file-"), F.col("file_id").cast("string"), F.lit(".jsonl"))
    return rows.select("file_id", "line_no", normalize.conversation_id("v", source).alias("cid"))


@query("SELECT conversation_id, substr(sha1(coalesce(title, '') || '|' || coalesce(CAST(CAST(trunc(coalesce(create_time, update_time) * 1000) AS BIGINT) AS VARCHAR), '')), 1, 12) AS digest FROM thread_meta")
def sha1_id_fallback(spark, d):
    made = F.coalesce(times.epoch_ms(F.coalesce("create_time", "update_time")).cast("string"), F.lit(""))
    return table(spark, d, "thread_meta").select("conversation_id", F.substring(F.sha1(F.concat(F.coalesce("title", F.lit("")), F.lit("|"), made)), 1, 12).alias("digest"))


@query(None)
def flatten_parts_loose(spark, d):
    v = nodes(spark, d).withColumn("v", F.try_parse_json("message")).where(normalize.is_object(F.col("v")))
    return v.select("conversation_id", "node_id", normalize.flatten_parts(F.try_variant_get("v", "$.content.parts", "array<variant>")).alias("text"))


@query(
    f"""WITH {JSON}, p AS (SELECT conversation_id, node_id, json_extract(j, '$.content.parts[*]') AS ps FROM js WHERE json_type(j, '$.content.parts') = 'ARRAY'),
    t AS (SELECT conversation_id, node_id, list_transform(ps, lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN x->>'$' WHEN json_type(x) = 'OBJECT' THEN coalesce(CASE WHEN json_type(x, '$.text') = 'VARCHAR' THEN nullif(x->>'$.text', '') END, CASE WHEN json_type(x, '$.delta') = 'VARCHAR' THEN nullif(x->>'$.delta', '') END) END) AS ts FROM p)
    SELECT conversation_id, node_id, CASE WHEN len(list_filter(ts, lambda x: x IS NULL)) = 0 THEN array_to_string(list_transform(ts, lambda x: regexp_replace(regexp_replace(regexp_replace(replace(x, chr(160), ' '), '[\\x00-\\x1F\\x7F]', '', 'g'), '{WHITE}+', ' ', 'g'), '^{WHITE}+|{WHITE}+$', '', 'g')), ' ') END AS text FROM t"""
)
def flatten_parts_strict(spark, d):
    v = nodes(spark, d).withColumn("v", F.try_parse_json("message")).where(F.try_variant_get("v", "$.content.parts", "array<variant>").isNotNull())
    return v.select("conversation_id", "node_id", normalize.flatten_parts(F.try_variant_get("v", "$.content.parts", "array<variant>"), strict=True).alias("text"))


@query(None)
def content_text(spark, d):
    v = nodes(spark, d).withColumn("v", F.try_parse_json("message")).where(normalize.is_object(F.col("v")))
    return v.select("conversation_id", "node_id", normalize.content_text(F.try_variant_get("v", "$.content", "variant")).alias("text"))


FIELDS = fieldmap.FieldMap(
    {"message_id": "$.id", "role": "$.author.role | lower | unknown", "ts": "$.create_time | epoch_ms", "model": "$.metadata.model_slug | null", "status": "$.status | upper | NONE", "text": "$.content.parts | strings | join"},
    required=("message_id", "ts"),
    values={"role": {"tool": "function"}},
)


@query(
    f"""WITH {JSON} SELECT conversation_id, json_extract_string(j, '$.id') AS message_id,
      CASE coalesce(lower(CASE WHEN json_type(j, '$.author.role') = 'VARCHAR' THEN json_extract_string(j, '$.author.role') END), 'unknown') WHEN 'tool' THEN 'function' ELSE coalesce(lower(CASE WHEN json_type(j, '$.author.role') = 'VARCHAR' THEN json_extract_string(j, '$.author.role') END), 'unknown') END AS role,
      CAST(trunc(TRY_CAST(json_extract_string(j, '$.create_time') AS DOUBLE) * 1000) AS BIGINT) AS ts,
      CASE WHEN json_type(j, '$.metadata.model_slug') = 'VARCHAR' THEN json_extract_string(j, '$.metadata.model_slug') END AS model,
      coalesce(upper(CASE WHEN json_type(j, '$.status') = 'VARCHAR' THEN json_extract_string(j, '$.status') END), 'NONE') AS status,
      CASE WHEN json_type(j, '$.content.parts') = 'ARRAY' THEN array_to_string(list_transform(list_filter(json_extract(j, '$.content.parts[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$'), chr(10)) END AS text
    FROM js WHERE json_type(j, '$.id') = 'VARCHAR' AND TRY_CAST(json_extract_string(j, '$.create_time') AS DOUBLE) IS NOT NULL"""
)
def declared_fields(spark, d):
    rows = nodes(spark, d).select("conversation_id", F.try_parse_json("message").alias("v")).where(normalize.is_object(F.col("v")))
    return fieldmap.apply_map(rows, FIELDS).drop("v")


@query(None)
def normalized_text(spark, d):
    v = nodes(spark, d).withColumn("v", F.try_parse_json("message")).where(normalize.is_object(F.col("v")))
    content = F.try_variant_get("v", "$.content", "variant")
    both = normalize.normalize_structure(content, ("user_profile",))
    return v.select("conversation_id", "node_id", normalize.normalize_text(content, ("user_profile",), loose=False).alias("text"), F.size(both["parts"]).cast("bigint").alias("n_parts"))


# Threads.


@query(f"WITH {MESSAGES} SELECT 'openai' AS provider_id, conversation_id, count(*) AS message_count, min(ts) AS ts_min, max(ts) AS ts_max, coalesce(array_to_string(list_sort(list(DISTINCT model) FILTER (model IS NOT NULL)), ','), '') AS models FROM msgs GROUP BY conversation_id")
def thread_index(spark, d):
    return threads.thread_index(messages(spark, d)).withColumn("models", F.array_join("models", ","))


@query(f"WITH {MESSAGES} SELECT 'thread' AS record_type, 'openai' AS provider_id, conversation_id, count(*) AS message_count FROM msgs GROUP BY conversation_id")
def thread_header(spark, d):
    return threads.thread_headers(threads.thread_index(messages(spark, d)))


@query(f"WITH {MESSAGES} SELECT count(DISTINCT conversation_id) AS threads, count(*) AS messages FROM msgs")
def run_stats(spark, d):
    return threads.run_stats(threads.thread_index(messages(spark, d)))


@query(f"WITH {PARSED} SELECT provider_id, conversation_id, message_id, row_number() OVER (PARTITION BY provider_id, conversation_id ORDER BY ts NULLS LAST, message_id) AS position FROM pm")
def order_messages(spark, d):
    return threads.positions(parsed(spark, d)).select("provider_id", "conversation_id", "message_id", "position")


@query(f"WITH {PARSED} SELECT provider_id, conversation_id, message_id, ts, text FROM pm")
def dedupe_messages(spark, d):
    return parsed(spark, d).select("provider_id", "conversation_id", "message_id", "ts", "text")


@query(f"WITH {PARSED} SELECT provider_id, conversation_id, coalesce('[' || string_agg(DISTINCT '\"' || meta['model'] || '\"', ', ' ORDER BY '\"' || meta['model'] || '\"') FILTER (meta['model'] IS NOT NULL) || ']', '[]') AS models FROM pm GROUP BY ALL")
def models_set(spark, d):
    t = threads.thread_index(parsed(spark, d))
    return t.select("provider_id", "conversation_id", text.yaml_list(F.col("models")).alias("models"))


@query(f"WITH {PARSED} SELECT p.conversation_id, p.message_id, coalesce(meta['model'], CASE WHEN role = 'assistant' THEN default_model_slug END) AS model FROM pm p LEFT JOIN thread_meta t ON t.conversation_id = p.conversation_id")
def enrich_models(spark, d):
    m = threads.enrich_models(parsed(spark, d), table(spark, d, "thread_meta"))
    return m.select("conversation_id", "message_id", F.col("meta")["model"].alias("model"))


@query(f"WITH {PARSED} SELECT p.conversation_id, p.message_id, coalesce(p.ts, CAST(trunc(create_time * 1000) AS BIGINT)) AS ts FROM pm p LEFT JOIN thread_meta t ON t.conversation_id = p.conversation_id")
def fill_times(spark, d):
    return threads.fill_times(parsed(spark, d), table(spark, d, "thread_meta")).select("conversation_id", "message_id", "ts")


@query(f"WITH {PARSED} SELECT conversation_id, count(*) AS messages, {iso_sql('min(ts)')} AS first, {iso_sql('max(ts)')} AS last FROM pm GROUP BY conversation_id")
def thread_meta_summary(spark, d):
    m = parsed(spark, d).groupBy("conversation_id").agg(F.count("*").alias("messages"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return m.select("conversation_id", "messages", times.iso_utc(F.col("a")).alias("first"), times.iso_utc(F.col("b")).alias("last"))


# Validation.

BAD = {
    "conversation_id": "coalesce(conversation_id = '', true)",
    "message_id": "coalesce(message_id = '', true)",
    "role": "coalesce(role = '', true)",
    "ts": "ts IS NULL",
    "content": "content IS NULL",
    "content.content_type": "content IS NOT NULL AND coalesce(content.content_type = '', true)",
    "content.parts": "content IS NOT NULL AND (content.parts IS NULL OR len(list_filter(content.parts, lambda x: x IS NULL)) > 0)",
    "text": "text IS NULL",
}
REASONS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {bad} THEN '{r}' END" for r, bad in BAD.items()) + "], lambda x: x IS NOT NULL), ',')"


@query(f"WITH {PARSED} SELECT provider_id, conversation_id, message_id, {REASONS} AS reasons FROM pm WHERE {REASONS} <> ''")
def validate_reasons(spark, d):
    m = validate.with_reasons(parsed(spark, d)).where("NOT valid")
    return m.select("provider_id", "conversation_id", "message_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {PARSED} SELECT provider_id, {REASONS} = '' AS valid, count(*) AS n FROM pm GROUP BY ALL")
def validate_flags(spark, d):
    return validate.with_reasons(parsed(spark, d)).groupBy("provider_id", "valid").agg(F.count("*").alias("n"))


def _records(spark, d) -> DataFrame:
    p = parsed(spark, d)
    record = F.struct(F.lit("message").alias("record_type"), "provider_id", "conversation_id", "message_id", "parent_id", "role", "ts", "content", "text")
    # JSON leaves nulls out: a missing parent is no violation, a missing role is one.
    return p.select(F.col("conversation_id").alias("path"), F.col("message_id").alias("line_no"), F.try_parse_json(F.to_json(record)).alias("v"))


@query(
    f"""WITH {PARSED}
    SELECT conversation_id AS path, message_id AS line_no, 'role' AS field_path FROM pm WHERE role = ''
    UNION ALL SELECT conversation_id, message_id, '<root>' FROM pm WHERE role IS NULL
    UNION ALL SELECT conversation_id, message_id, '<root>' FROM pm WHERE ts IS NULL
    UNION ALL SELECT conversation_id, message_id, 'ts' FROM pm WHERE ts < 0"""
)
def schema_violations(spark, d):
    return validate.violations(_records(spark, d), validate.schema_file("message")).select("path", "line_no", "field_path")


@query(
    f"""WITH {PARSED}, x AS (SELECT conversation_id AS path, message_id AS line_no, CASE WHEN role IS NULL OR ts IS NULL THEN '<root>' WHEN role = '' THEN 'role' WHEN ts < 0 THEN 'ts' END AS field_path FROM pm)
    SELECT * FROM x WHERE field_path IS NOT NULL"""
)
def first_violation(spark, d):
    found = validate.violations(_records(spark, d), validate.schema_file("message"))
    return validate.first_violation(found).select("path", "line_no", "field_path")


# Trees.


@query(f"WITH {NODES} SELECT n.conversation_id, n.node_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes p WHERE p.conversation_id = n.conversation_id AND p.node_id = n.parent)")
def roots_anti_join(spark, d):
    return tree.roots(nodes(spark, d))


CHILD = NODES + ", ce AS (SELECT DISTINCT n.conversation_id, n.node_id AS parent_id, c.x AS node_id FROM nodes n, unnest(n.children) AS c(x) WHERE EXISTS (SELECT 1 FROM nodes k WHERE k.conversation_id = n.conversation_id AND k.node_id = c.x))"


@query(f"WITH {CHILD} SELECT conversation_id, parent_id, node_id FROM ce")
def child_semi_join(spark, d):
    return tree.child_edges(nodes(spark, d))


@query(
    f"""WITH {CHILD} SELECT conversation_id, parent_id, node_id FROM ce UNION ALL
    SELECT n.conversation_id, n.parent, n.node_id FROM nodes n WHERE n.parent <> '' AND n.conversation_id NOT IN (SELECT conversation_id FROM ce)
    AND EXISTS (SELECT 1 FROM nodes p WHERE p.conversation_id = n.conversation_id AND p.node_id = n.parent)"""
)
def parent_fallback_edges(spark, d):
    return tree.edges(nodes(spark, d))


@query(f"WITH {NODES} SELECT n.conversation_id, n.node_id, n.parent FROM nodes n WHERE n.parent <> '' AND NOT EXISTS (SELECT 1 FROM nodes p WHERE p.conversation_id = n.conversation_id AND p.node_id = n.parent)")
def orphan_parents(spark, d):
    return tree.orphans(nodes(spark, d))


LEVELS = (
    "RECURSIVE "
    + NODES
    + """, up AS (SELECT n.conversation_id, n.node_id, p.node_id AS parent FROM nodes n LEFT JOIN nodes p ON p.conversation_id = n.conversation_id AND p.node_id = n.parent),
    lv AS (SELECT conversation_id, node_id, node_id AS root_id, CAST(0 AS BIGINT) AS depth FROM up WHERE parent IS NULL
      UNION ALL SELECT u.conversation_id, u.node_id, l.root_id, l.depth + 1 FROM up u JOIN lv l ON l.conversation_id = u.conversation_id AND l.node_id = u.parent),
    al AS (SELECT u.conversation_id, u.node_id, coalesce(l.root_id, '') AS root_id, coalesce(l.depth, -1) AS depth, l.root_id IS NULL AS cyclic FROM up u LEFT JOIN lv l ON l.conversation_id = u.conversation_id AND l.node_id = u.node_id)"""
)


@query(f"WITH {LEVELS} SELECT conversation_id, node_id, root_id, depth, cyclic FROM al")
def bfs_depth(spark, d):
    return tree.levels(nodes(spark, d))


@query(f"WITH {LEVELS} SELECT al.conversation_id, al.node_id, row_number() OVER (PARTITION BY al.conversation_id ORDER BY cyclic, depth, n.create_time NULLS LAST, al.node_id) AS position FROM al JOIN nodes n ON n.conversation_id = al.conversation_id AND n.node_id = al.node_id")
def linear_order(spark, d):
    return tree.reading_order(nodes(spark, d)).select("conversation_id", "node_id", "position")


# Scalar functions.


@query(f"WITH {PARSED} SELECT message_id, {iso_sql('ts')} AS iso FROM pm")
def iso_utc(spark, d):
    return parsed(spark, d).select("message_id", times.iso_utc(F.col("ts")).alias("iso"))


@query(f"WITH {PARSED} SELECT message_id, coalesce(strftime(timezone('Asia/Tokyo', timezone('UTC', make_timestamp({MS} * 1000))), '%Y-%m-%d %H:%M'), '') AS tokyo FROM pm")
def local_human_tz(spark, d):
    return parsed(spark, d).select("message_id", times.local_human(F.col("ts"), "Asia/Tokyo").alias("tokyo"))


@query(f"WITH {PARSED} SELECT message_id, coalesce(strftime(make_timestamp({MS} * 1000), '%Y年%m月%d日 %H:%M'), '') AS ja FROM pm")
def locale_dates(spark, d):
    return parsed(spark, d).select("message_id", times.local_human(F.col("ts"), "UTC", "ja").alias("ja"))


@query(f"WITH {PARSED} SELECT message_id, {MS} AS ms FROM pm")
def ts_unit_heuristic(spark, d):
    return parsed(spark, d).select("message_id", times.millis(F.col("ts")).alias("ms"))


@query(
    """WITH b AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) * (1 + doc_id % 5) * CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS n FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, n, CASE WHEN n < 1024 THEN printf('%.1fB', CAST(n AS DOUBLE)) WHEN n < 1048576 THEN printf('%.1fKiB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1fMiB', n / 1048576.0::DOUBLE) WHEN n < 1099511627776 THEN printf('%.1fGiB', n / 1073741824.0::DOUBLE) ELSE printf('%.1fTiB', n / 1099511627776.0::DOUBLE) END AS size FROM b"""
)
def format_bytes(spark, d):
    factor = F.when(F.col("doc_id") % 4 == 0, 1).when(F.col("doc_id") % 4 == 1, 1024).when(F.col("doc_id") % 4 == 2, 1048576).otherwise(1073741824)
    n = F.octet_length("text").cast("bigint") * (1 + F.col("doc_id") % 5) * factor
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", n.alias("n")).withColumn("size", sizes.format_bytes(F.col("n")))


@query(
    """WITH s AS (SELECT doc_id, abs(coalesce(n_chars, 7)) AS n, CAST(doc_id % 8 AS INTEGER) AS k FROM documents)
    SELECT doc_id, CASE WHEN k = 0 THEN n WHEN k = 1 THEN n * 1024 WHEN k = 2 THEN n * 1000 WHEN k = 3 THEN n * 1048576 WHEN k = 4 THEN n WHEN k = 5 THEN n * 1000000000 WHEN k = 6 THEN NULL ELSE n * 1048576 END AS bytes FROM s"""
)
def parse_size(spark, d):
    units = F.array(*(F.lit(u) for u in ("", "K", "kb", "MiB", "B", "GB", ".5M", "m")))
    literal = F.concat(F.abs(F.coalesce("n_chars", F.lit(7))).cast("string"), F.element_at(units, (F.col("doc_id") % 8 + 1).cast("int")))
    return table(spark, d, "documents").select("doc_id", sizes.parse_size_column(literal).alias("bytes"))


@query(
    rf"""WITH n AS (SELECT conversation_id, regexp_replace(regexp_replace(regexp_replace(repeat(coalesce(title, ''), 4) || '.md', '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), '{WHITE}+', ' ', 'g'), '^{WHITE}+|{WHITE}+$', '', 'g') AS x FROM thread_meta)
    SELECT conversation_id, CASE WHEN length(x) > 120 THEN substr(x, 1, 114) || '....md' ELSE x END AS name FROM n"""
)
def sanitize_filename(spark, d):
    return table(spark, d, "thread_meta").select("conversation_id", text.sanitize_filename(F.concat(F.repeat(F.coalesce("title", F.lit("")), 4), F.lit(".md"))).alias("name"))


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[\x00-\x1F\x7F]', '', 'g'), '{WHITE}+', ' ', 'g'), '^{WHITE}+|{WHITE}+$', '', 'g')) AS clean FROM documents WHERE text IS NOT NULL")
def sanitize_text(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.sanitize(F.col("text"))).alias("clean"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, 'https?://[^\s<>\)\"'']+', '***', 'g'), '[0-9a-f]{12,}', '***', 'g') AS masked FROM documents WHERE text IS NOT NULL")
def mask_patterns(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.mask(F.col("text"), [r"https?://[^\s<>\)\"']+", r"[0-9a-f]{12,}"]).alias("masked"))


@query("WITH t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), " + light_sql("t", "doc_id") + " SELECT t.doc_id, md5(coalesce(lf.out, '')) AS formatted FROM t LEFT JOIN lf ON lf.doc_id = t.doc_id")
def light_format(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.light_format(F.col("text"))).alias("formatted"))


# Rendering.

BLOCKS = (
    PARSED
    + ", src AS (SELECT provider_id, conversation_id, message_id, parent_id, role, ts, meta['model'] AS model, provider_id || chr(1) || conversation_id || chr(1) || message_id AS id, CASE WHEN coalesce(text, '') = '' THEN coalesce(array_to_string(content.parts, chr(10)), '') ELSE text END AS text FROM pm), "
    + light_sql("src", "id")
    + f""", bl AS (SELECT src.*, '## [' || coalesce(role, 'unknown') || '] ' || coalesce(strftime(make_timestamp({MS} * 1000), '%Y-%m-%d %H:%M'), '') || chr(10)
      || '- message_id: ' || message_id || chr(10) || CASE WHEN coalesce(parent_id, '') <> '' THEN '- parent_id: ' || parent_id || chr(10) ELSE '' END || chr(10) || coalesce(lf.out, '') || chr(10) || chr(10) AS block
    FROM src LEFT JOIN lf ON lf.id = src.id)"""
)


@query(f"WITH {BLOCKS} SELECT conversation_id, message_id, md5(block) AS block, CAST(strlen(block) AS BIGINT) AS bytes FROM bl")
def render_block(spark, d):
    return render.blocks(parsed(spark, d)).select("conversation_id", "message_id", F.md5("block").alias("block"), "bytes")


@query(f"WITH {BLOCKS} SELECT provider_id, conversation_id, CAST(sum(strlen(block)) AS BIGINT) AS bytes FROM bl GROUP BY ALL")
def body_bytes(spark, d):
    return render.blocks(parsed(spark, d)).groupBy("provider_id", "conversation_id").agg(F.sum("bytes").alias("bytes"))


def front_sql(head: str = "messages", n: str = "count(*)", extra: str = "") -> str:
    models = "coalesce('[' || string_agg(DISTINCT '\"' || model || '\"', ', ' ORDER BY '\"' || model || '\"') FILTER (model IS NOT NULL) || ']', '[]')"
    return f"'---' || chr(10) || 'thread: ' || conversation_id || chr(10) || 'provider: ' || provider_id || chr(10) || '{head}: ' || CAST({n} AS VARCHAR) || chr(10) || 'models: ' || {models} || chr(10) || 'range: ' || {iso_sql('min(ts)')} || ' 〜 ' || {iso_sql('max(ts)')} || chr(10){extra} || '---' || chr(10)"


@query(f"WITH {PARSED}, src AS (SELECT *, meta['model'] AS model FROM pm) SELECT provider_id, conversation_id, {front_sql()} AS front FROM src GROUP BY provider_id, conversation_id")
def front_matter(spark, d):
    t = threads.thread_index(parsed(spark, d))
    return t.select("provider_id", "conversation_id", render.front_matter().alias("front"))


@query(
    f"""WITH {BLOCKS} SELECT provider_id, conversation_id, CAST(0 AS BIGINT) AS position, md5({front_sql()}) AS chunk FROM bl GROUP BY provider_id, conversation_id
    UNION ALL SELECT provider_id, conversation_id, row_number() OVER (PARTITION BY provider_id, conversation_id ORDER BY ts IS NULL, ts, message_id), md5(block) FROM bl"""
)
def thread_markdown(spark, d):
    return render.thread_chunks(parsed(spark, d)).withColumn("chunk", F.md5("chunk"))


# Splitting.


def pack_sql(spec: split.SplitSpec) -> str:
    """Parts of each thread by a step per message."""
    over_size = f"p.used + s.b + 1024 > {spec.size_limit}" if spec.size_limit else "false"
    over_count = f"(NOT ({over_size}) AND p.held >= {spec.count_limit})" if spec.count_limit else "false"
    within = f"(NOT {over_count} AND p.used + s.b + 1024 <= {spec.soft_limit})" if spec.size_limit else "false"
    stay = "false" if spec.hard else f"({within} OR s.n - s.i <= {spec.tiny_tail})"
    flush = f"((({over_size}) OR {over_count}) AND NOT {stay})"
    return f"""WITH RECURSIVE {BLOCKS}, s AS (SELECT provider_id, conversation_id, CAST(strlen(block) AS BIGINT) AS b, row_number() OVER (PARTITION BY provider_id, conversation_id ORDER BY ts IS NULL, ts, message_id) AS i, count(*) OVER (PARTITION BY provider_id, conversation_id) AS n FROM bl),
    p AS (SELECT provider_id, conversation_id, i, CAST(1 AS BIGINT) AS part, b AS used, CAST(1 AS BIGINT) AS held, b FROM s WHERE i = 1
      UNION ALL SELECT s.provider_id, s.conversation_id, s.i, p.part + CASE WHEN {flush} THEN 1 ELSE 0 END, CASE WHEN {flush} THEN 0 ELSE p.used END + s.b, CASE WHEN {flush} THEN 0 ELSE p.held END + 1, s.b
      FROM p JOIN s ON s.provider_id = p.provider_id AND s.conversation_id = p.conversation_id AND s.i = p.i + 1),
    parts AS (SELECT conversation_id, part AS part_index, count(*) AS message_count, CAST(sum(b) AS BIGINT) AS bytes FROM p GROUP BY ALL),
    named AS (SELECT *, max(part_index) OVER (PARTITION BY conversation_id) AS part_total FROM parts)
    SELECT conversation_id, part_index, message_count, bytes, part_total, 'thread-' || conversation_id || CASE WHEN part_total > 1 THEN '__part' || lpad(CAST(part_index AS VARCHAR), CAST(greatest(2, length(CAST(part_index AS VARCHAR))) AS INTEGER), '0') ELSE '' END || '.md' AS file_name FROM named"""


SPECS = {
    "split_count": split.SplitSpec.parse("count=10", tiny_tail=0),
    "split_count_tail": split.SplitSpec.parse("count=10"),
    "split_size": split.SplitSpec.parse("size=4K", tiny_tail=2),
    "split_hard": split.SplitSpec.parse("size=4096", hard=True),
    "split_auto": split.SplitSpec.parse("auto"),
}


def _split(name: str, spec: split.SplitSpec):
    def run(spark, d):
        s = split.part_summary(split.assign_parts(parsed(spark, d), spec))
        return s.withColumns({"part_index": F.col("part_index").cast("bigint"), "part_total": F.col("part_total").cast("bigint")})

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = pack_sql(spec)


for _name, _spec in SPECS.items():
    _split(_name, _spec)


@query(pack_sql(SPECS["split_size"]))
def split_in_row(spark, d):
    s = split.part_summary(split.assign_parts_in_row(parsed(spark, d), SPECS["split_size"]))
    return s.withColumns({"part_index": F.col("part_index").cast("bigint"), "part_total": F.col("part_total").cast("bigint")})


@query(f"WITH {BLOCKS} SELECT conversation_id, count(*) AS messages, CAST(sum(strlen(block)) AS BIGINT) AS bytes, CAST(greatest(1, sum(strlen(block)) // 4096) AS BIGINT) AS parts FROM bl GROUP BY conversation_id")
def split_preview(spark, d):
    return render.preview(parsed(spark, d), 4096)


@query(f"WITH {PARSED} SELECT conversation_id, strftime(make_timestamp({MS} * 1000), '%Y-%m') AS month, count(*) AS messages FROM pm WHERE ts IS NOT NULL GROUP BY ALL")
def split_by_date(spark, d):
    month = F.date_format(F.timestamp_millis(times.millis(F.col("ts"))), "yyyy-MM")
    return parsed(spark, d).where("ts IS NOT NULL").groupBy("conversation_id", month.alias("month")).agg(F.count("*").alias("messages"))


# Incremental runs: the manifest's entries against the threads as parsed.


def _old(spark, d) -> DataFrame:
    listed = table(spark, d, "manifest").select("provider", "file_id", F.inline("index.threads"))
    return threads.latest_rows(listed, ["conversation_id"], ["file_id"]).select("provider", "conversation_id", "path", "count", "ts_min", "ts_max")


OLD = "old AS (SELECT provider, conversation_id, path, count, ts_min, ts_max FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY file_id DESC) AS rn FROM (SELECT provider, file_id, unnest(index.threads, recursive := true) FROM manifest)) WHERE rn = 1)"
CLASSIFIED = PARSED + ", " + OLD + ", ix AS (SELECT provider_id, conversation_id, count(*) AS message_count, min(ts) AS ts_min, max(ts) AS ts_max FROM pm GROUP BY ALL), cl AS (SELECT ix.*, old.count AS old_count, CASE WHEN old.conversation_id IS NULL THEN 'NEW' WHEN old.count = ix.message_count THEN 'SKIP' ELSE 'REPLACE' END AS decision, CASE WHEN old.conversation_id IS NULL THEN 'NEW' WHEN ix.ts_max < old.ts_max THEN 'WARN' WHEN old.count = ix.message_count AND old.ts_max IS NOT DISTINCT FROM ix.ts_max THEN 'SKIP' ELSE 'REPLACE' END AS by_time FROM ix LEFT JOIN old ON old.conversation_id = ix.conversation_id)"


@query(f"WITH {CLASSIFIED} SELECT provider_id, conversation_id, message_count, old_count, decision FROM cl")
def incremental_classify(spark, d):
    c = incremental.classify(threads.thread_index(parsed(spark, d)), _old(spark, d))
    return c.select("provider_id", "conversation_id", "message_count", "old_count", "decision")


@query(f"WITH {CLASSIFIED} SELECT provider_id, conversation_id, by_time AS decision FROM cl")
def incremental_by_time(spark, d):
    return incremental.classify(threads.thread_index(parsed(spark, d)), _old(spark, d), "time").select("provider_id", "conversation_id", "decision")


@query(
    f"""WITH {CLASSIFIED}, fresh AS (SELECT provider_id AS provider, conversation_id, 'thread-' || conversation_id || '/parsed.jsonl' AS path, message_count AS count, ts_min, ts_max FROM cl WHERE decision <> 'SKIP')
    SELECT * FROM fresh UNION ALL SELECT provider, conversation_id, path, count, ts_min, ts_max FROM old WHERE conversation_id NOT IN (SELECT conversation_id FROM fresh)"""
)
def manifest_merge(spark, d):
    old = _old(spark, d)
    return incremental.merge_manifest(incremental.classify(threads.thread_index(parsed(spark, d)), old), old)
