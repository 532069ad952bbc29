"""Node graphs: edges, roots, orphans, levels and reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.operators.hierarchy import label_forest
from chatlake.operators.threads import numbered

_KEY = ["conversation_id", "node_id"]


def child_edges(nodes: DataFrame) -> DataFrame:
    """(conversation_id, parent_id, node_id): listed children that are nodes of the thread, once each."""
    listed = nodes.select("conversation_id", F.col("node_id").alias("parent_id"), F.explode("children").alias("node_id")).where("node_id IS NOT NULL").distinct()
    return listed.join(nodes.select(*_KEY), _KEY, "left_semi").select("conversation_id", "parent_id", "node_id")


def edges(nodes: DataFrame) -> DataFrame:
    """``child_edges``, or the edges by parent where a whole thread lists no valid child."""
    listed = child_edges(nodes)
    without = nodes.join(listed.select("conversation_id").distinct(), "conversation_id", "left_anti")
    known = nodes.select("conversation_id", F.col("node_id").alias("parent"))
    by_parent = without.where("parent <> ''").join(known, ["conversation_id", "parent"], "left_semi").select("conversation_id", F.col("parent").alias("parent_id"), "node_id")
    return listed.unionByName(by_parent)


def roots(nodes: DataFrame) -> DataFrame:
    """Nodes without a parent in their thread."""
    known = nodes.select("conversation_id", F.col("node_id").alias("parent"))
    return nodes.join(known, ["conversation_id", "parent"], "left_anti").select(*_KEY)


def orphans(nodes: DataFrame) -> DataFrame:
    """(conversation_id, node_id, parent): nodes that name a parent which is not there."""
    known = nodes.select("conversation_id", F.col("node_id").alias("parent"))
    return nodes.where("parent <> ''").join(known, ["conversation_id", "parent"], "left_anti").select(*_KEY, "parent")


def levels(nodes: DataFrame) -> DataFrame:
    """(conversation_id, node_id, root_id, depth, cyclic) by parent; trees of any depth, by contraction."""
    return label_forest(nodes.select(*_KEY, F.col("parent").alias("parent_id"))).drop("path")


def reading_order(nodes: DataFrame) -> DataFrame:
    """Nodes with ``position`` in their thread: by level, then time (unknown last), then id; nodes in cycles come last."""
    at = nodes.select(*_KEY, "create_time")
    rows = levels(nodes).join(at, _KEY)
    return numbered(rows, ["conversation_id"], [F.col("cyclic").asc(), F.col("depth").asc(), F.col("create_time").asc_nulls_last(), F.col("node_id").asc()])
