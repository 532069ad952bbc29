"""Schemas of the canonical tables."""

MESSAGE = (
    "provider_id STRING, conversation_id STRING, message_id STRING, parent_id STRING, role STRING, ts BIGINT, "
    "content STRUCT<content_type: STRING, parts: ARRAY<STRING>>, text STRING, meta MAP<STRING, STRING>"
)
THREAD = "provider_id STRING, conversation_id STRING, message_count BIGINT, ts_min BIGINT, ts_max BIGINT, models ARRAY<STRING>"
MANIFEST = "provider STRING, conversation_id STRING, path STRING, count BIGINT, ts_min BIGINT, ts_max BIGINT"
PART = "conversation_id STRING, part_index INT, part_total INT, message_count BIGINT, bytes BIGINT, markdown STRING, file_name STRING"
VIOLATION = "path STRING, line_no BIGINT, field_path STRING, message STRING"
#: A line of parsed.jsonl: a thread header or a message.
PARSED = (
    "record_type STRING, provider_id STRING, conversation_id STRING, message_id STRING, parent_id STRING, role STRING, ts BIGINT, "
    "content STRUCT<content_type: STRING, parts: ARRAY<STRING>>, text STRING, meta MAP<STRING, STRING>, message_count BIGINT"
)
