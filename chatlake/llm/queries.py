"""The pN_ queries of the problems on LLM text, and their SQL where SQL can say it."""

from __future__ import annotations

from chatlake.llm import leakage, lookalike, markup, pii, spam, threads, tokenizer
from chatlake.sources.tables import table


def p1_found(spark, d):
    return lookalike.lookalike_pairs(table(spark, d, "mapping"))


def p1_forms(spark, d):
    return lookalike.canonical_parts(table(spark, d, "mapping"))


def p2_found(spark, d):
    return markup.markup_found(table(spark, d, "mapping"))


def p2_clean(spark, d):
    return markup.clean_parts(table(spark, d, "mapping"))


def p3_found(spark, d):
    return threads.dropped_threads(table(spark, d, "parsed"))


def p3_turns(spark, d):
    return threads.turns(table(spark, d, "parsed"))


def p3_threads(spark, d):
    return threads.assembled(table(spark, d, "parsed"))[1]


def p6_found(spark, d):
    return pii.pii_found(table(spark, d, "mapping"))


def p6_masked(spark, d):
    return pii.masked_parts(table(spark, d, "mapping"))


def p8_ids(spark, d):
    return tokenizer.encode_corpus(table(spark, d, "documents"))


def p9_found(spark, d):
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark, d):
    return spam.spam_pages(table(spark, d, "documents")).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_forms, p2_found, p2_clean, p3_found, p3_turns, p3_threads, p6_found, p6_masked, p8_ids, p9_found, p10_found)}

TURNS = """WITH m AS (
  SELECT DISTINCT ON (conversation_id, message_id) conversation_id, message_id, CASE WHEN ts < 100000000000 THEN ts * 1000 ELSE ts END AS ts,
    CASE r WHEN 'human' THEN 'user' WHEN 'model' THEN 'assistant' WHEN 'ai' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE r END AS speaker, coalesce(regexp_matches(text, '{VISIBLE}'), false) AS visible, text
  FROM (SELECT *, lower(trim(role)) AS r FROM parsed WHERE record_type = 'message' AND conversation_id IS NOT NULL)
  ORDER BY conversation_id, message_id, CASE WHEN ts < 100000000000 THEN ts * 1000 ELSE ts END NULLS FIRST, speaker NULLS FIRST, visible, text NULLS FIRST),
s AS (SELECT conversation_id, count(*) AS n, sum(CASE WHEN ts IS NULL OR ts <= 0 OR speaker IS NULL OR speaker NOT IN ('user', 'assistant', 'system', 'tool') THEN 1 ELSE 0 END) AS bad,
    arg_min(speaker, (ts, message_id)) FILTER (visible AND speaker IN ('user', 'assistant')) AS first, arg_max(speaker, (ts, message_id)) FILTER (visible AND speaker IN ('user', 'assistant')) AS last FROM m GROUP BY conversation_id),
h AS (SELECT conversation_id, max(CASE WHEN record_type = 'thread' THEN message_count END) AS stated FROM parsed WHERE conversation_id IS NOT NULL GROUP BY conversation_id),
kept AS (SELECT s.conversation_id FROM s LEFT JOIN h ON h.conversation_id = s.conversation_id WHERE coalesce(stated, 0) <= n AND bad = 0 AND first = 'user' AND last = 'assistant')
SELECT m.conversation_id, row_number() OVER (PARTITION BY m.conversation_id ORDER BY ts, message_id) AS turn, message_id, ts, speaker, text FROM m JOIN kept ON kept.conversation_id = m.conversation_id"""

VISIBLE = r"[^\s\p{Z}\p{Cc}\p{Cf}]"
SQL: dict[str, str] = {
    "p3_found": f"""WITH m AS (
  SELECT DISTINCT ON (conversation_id, message_id) conversation_id, message_id, CASE WHEN ts < 100000000000 THEN ts * 1000 ELSE ts END AS ts,
    CASE r WHEN 'human' THEN 'user' WHEN 'model' THEN 'assistant' WHEN 'ai' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE r END AS role, coalesce(regexp_matches(text, '{VISIBLE}'), false) AS visible
  FROM (SELECT *, lower(trim(role)) AS r FROM parsed WHERE record_type = 'message' AND conversation_id IS NOT NULL) ORDER BY conversation_id, message_id, ts, role),
s AS (SELECT conversation_id, count(*) AS n, sum(CASE WHEN ts IS NULL OR ts <= 0 OR role IS NULL OR role NOT IN ('user', 'assistant', 'system', 'tool') THEN 1 ELSE 0 END) AS bad,
    arg_min(role, (ts, message_id)) FILTER (visible AND role IN ('user', 'assistant')) AS first, arg_max(role, (ts, message_id)) FILTER (visible AND role IN ('user', 'assistant')) AS last FROM m GROUP BY conversation_id),
h AS (SELECT conversation_id, max(CASE WHEN record_type = 'thread' THEN message_count END) AS stated FROM parsed WHERE conversation_id IS NOT NULL GROUP BY conversation_id)
SELECT h.conversation_id FROM h LEFT JOIN s ON s.conversation_id = h.conversation_id WHERE coalesce(stated, 0) > coalesce(n, 0) OR coalesce(bad, 0) > 0 OR NOT coalesce(first = 'user' AND last = 'assistant', false)""",
    "p3_turns": TURNS.replace("{VISIBLE}", VISIBLE),
    "p9_found": """WITH w AS (SELECT item_id, regexp_extract_all(lower(prompt), '[\\p{L}\\p{N}]+') AS ws FROM eval_items),
g AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 11], ' ') AS p FROM w, unnest(range(1, len(ws) - 10)) AS r(i)),
own AS (SELECT p, min(item_id) AS item_id FROM g GROUP BY p HAVING count(*) = 1),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(ws[i:i + 11], ' ') AS p FROM d, unnest(range(1, len(ws) - 10)) AS r(i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN own ON own.p = dg.p""",
}
