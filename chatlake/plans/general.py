"""Queries of the general problems: drifting schemas, nested records, hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.operators import drift, hierarchy, nested
from chatlake.sources.tables import table


def p4_found(spark, d):
    return drift.schema_changes(table(spark, d, "raw_records"), table(spark, d, "manifest"))


def p4_table(spark, d):
    out = drift.unified(table(spark, d, "raw_records"), table(spark, d, "manifest"))
    return out.drop("typed", "valid", "shape").withColumn("rescued", F.to_json("rescued"))


def p5_found(spark, d):
    return nested.item_links(table(spark, d, "mapping"))


def p5_items(spark, d):
    return nested.nested_items(table(spark, d, "mapping")).distinct()


def p7_found(spark, d):
    return hierarchy.hierarchy(table(spark, d, "mapping"), table(spark, d, "parsed")).select("conversation_id", "node_id", "root_id", F.col("depth").cast("int").alias("depth"))


def p7_paths(spark, d):
    return hierarchy.hierarchy(table(spark, d, "mapping"), table(spark, d, "parsed"), with_path=True)


def p7_descendants(spark, d):
    return hierarchy.all_descendants(table(spark, d, "mapping"), table(spark, d, "parsed"))[0]


def p7_descendant_counts(spark, d):
    return hierarchy.all_descendants(table(spark, d, "mapping"), table(spark, d, "parsed"))[1]


QUERIES = {f.__name__: f for f in (p4_found, p4_table, p5_found, p5_items, p7_found, p7_paths, p7_descendants, p7_descendant_counts)}

LINKS = """rows_ AS (
  SELECT conversation_id, node_id, parent AS named, NULL AS lister, true AS node FROM mapping
  UNION ALL SELECT conversation_id, unnest(children), NULL, node_id, false FROM mapping
  UNION ALL SELECT conversation_id, message_id, parent_id, NULL, true FROM parsed WHERE record_type = 'message' AND conversation_id NOT IN (SELECT conversation_id FROM mapping WHERE conversation_id IS NOT NULL)),
once AS (SELECT conversation_id, node_id, coalesce(max(named), min(lister)) AS parent FROM rows_ WHERE conversation_id IS NOT NULL AND node_id IS NOT NULL GROUP BY conversation_id, node_id HAVING bool_or(node)),
up AS (SELECT n.conversation_id, n.node_id, p.node_id AS parent FROM once n LEFT JOIN once p ON p.conversation_id = n.conversation_id AND p.node_id = n.parent),
lv AS (SELECT conversation_id, node_id, node_id AS root_id, CAST(0 AS INTEGER) AS depth FROM up WHERE parent IS NULL
  UNION ALL SELECT u.conversation_id, u.node_id, l.root_id, l.depth + 1 FROM up u JOIN lv l ON l.conversation_id = u.conversation_id AND l.node_id = u.parent)"""

PATHS = LINKS[: LINKS.index(",\nlv AS")] + """,
lp AS (SELECT conversation_id, node_id, [node_id] AS way FROM up WHERE parent IS NULL
  UNION ALL SELECT u.conversation_id, u.node_id, list_append(p.way, u.node_id) FROM up u JOIN lp p ON p.conversation_id = u.conversation_id AND p.node_id = u.parent)"""

SQL: dict[str, str] = {
    "p5_found": """WITH RECURSIVE m AS (SELECT DISTINCT node_id, message FROM mapping WHERE json_valid(message)),
w AS (
  SELECT node_id, CAST(message AS JSON) AS j, '' AS path, '' AS near FROM m
  UNION ALL
  SELECT node_id, c.j, c.path, c.near FROM (
    SELECT node_id, unnest(CASE WHEN json_type(j) = 'OBJECT'
        THEN [{'j': json_extract(j, '$."' || replace(k, '"', '\\"') || '"'), 'path': CASE WHEN path = '' THEN k ELSE path || '.' || k END, 'near': near} FOR k IN json_keys(j)]
        ELSE [{'j': json_extract(j, '$[' || i || ']'), 'path': path || '[' || i || ']', 'near': CASE WHEN json_type(json_extract(j, '$[' || i || ']')) = 'OBJECT' THEN near || chr(1) || path || '[' || i || ']' ELSE near END} FOR i IN range(CAST(json_array_length(j) AS BIGINT))] END) AS c
    FROM w WHERE json_type(j) IN ('OBJECT', 'ARRAY'))),
o AS (SELECT node_id, path, string_split(near, chr(1)) AS ps FROM w WHERE json_type(j) = 'OBJECT' AND path LIKE '%]')
SELECT DISTINCT node_id, path AS item_path, CASE WHEN len(ps) > 2 THEN ps[-2] ELSE '' END AS parent_path FROM o""",
    "p7_paths": f"WITH RECURSIVE {PATHS} SELECT u.conversation_id, u.node_id, coalesce(p.way[1], '') AS root_id, coalesce(len(p.way) - 1, -1) AS depth, p.way IS NULL AS cyclic, coalesce(array_to_string(p.way, '/'), '') AS path FROM up u LEFT JOIN lp p ON p.conversation_id = u.conversation_id AND p.node_id = u.node_id",
    "p7_descendants": f"WITH RECURSIVE {PATHS} SELECT conversation_id, unnest(way[:-2]) AS node_id, node_id AS descendant_id FROM lp WHERE len(way) > 1",
    "p7_descendant_counts": f"WITH RECURSIVE {PATHS}, d AS (SELECT conversation_id, a AS node_id, count(*) AS n FROM (SELECT conversation_id, unnest(way[:-2]) AS a FROM lp WHERE len(way) > 1) GROUP BY ALL) SELECT u.conversation_id, u.node_id, coalesce(d.n, 0) AS descendants FROM up u LEFT JOIN d ON d.conversation_id = u.conversation_id AND d.node_id = u.node_id",
    "p7_found": f"WITH RECURSIVE {LINKS} SELECT u.conversation_id, u.node_id, coalesce(l.root_id, '') AS root_id, coalesce(l.depth, -1) AS depth FROM up u LEFT JOIN lv l ON l.conversation_id = u.conversation_id AND l.node_id = u.node_id",
}
