"""Problem 7: parent-child rows as whole hierarchies.

Method: tree contraction. Leaves are raked and unary chains compressed in turn, every removal
is recorded, and the records are played back in reverse to give each node its root, depth and
path; cores that never shrink to a root are cycles.

Work is split in blocks: a thread of at most ``BLOCK_ROWS`` nodes is one block, a larger one is
spread over several by a hash of the node. Each block is contracted by numpy; what is left of a
split thread (the block roots, pointing into other blocks) is a smaller forest that is contracted
again, by distributed rounds while it exceeds one block. No task ever holds more than
``BLOCK_ROWS`` nodes of one thread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.session import materialize

#: Nodes of one thread in a block at most.
BLOCK_ROWS = 200_000
#: Separates the node ids in a path.
SLASH = "/"

_KEY = ["conversation_id", "node_id"]


def contract(parent: np.ndarray, weight: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Root, distance to it and "on or below a cycle" of each node of a forest given by parent numbers (-1: none)."""
    n = len(parent)
    par, dist = parent.astype(np.int64), weight.astype(np.int64)
    bad = np.zeros(n, dtype=bool)
    live = np.arange(n)
    log: list[np.ndarray] = []
    rng = np.random.default_rng(seed)
    while True:
        own = par[live] == live
        if own.any():  # a core that shrank onto itself: a cycle
            bad[live[own]] = True
            par[live[own]] = -1
        live_ = live[par[live] >= 0]
        if not len(live_):
            break
        # Rake: nodes that nobody points to.
        pointed = np.zeros(n, dtype=np.int32)
        np.add.at(pointed, par[live_], 1)
        leaf = live_[pointed[live_] == 0]
        log.append(leaf)
        gone = np.zeros(n, dtype=bool)
        gone[leaf] = True
        np.subtract.at(pointed, par[leaf], 1)
        live = live[~gone[live]]
        # Compress: nodes with one child are spliced out, none next to another.
        inner = live[par[live] >= 0]
        unary = inner[pointed[inner] == 1]
        if len(unary):
            chosen = np.zeros(n, dtype=bool)
            chosen[unary] = rng.random(len(unary)) < 0.5
            u = unary[chosen[unary]]
            u = u[~chosen[par[u]] & (par[u] != u)]
            if len(u):
                child = np.full(n, -1, dtype=np.int64)
                child[par[inner]] = inner
                c = child[u]
                par[c], dist[c] = par[u], dist[c] + dist[u]
                log.append(u)
                gone[u] = True
                live = live[~gone[live]]
    root, far = np.arange(n), np.zeros(n, dtype=np.int64)
    for removed in reversed(log):
        above = par[removed]
        root[removed] = root[above]
        far[removed] = far[above] + dist[removed]
        bad[removed] = bad[above]
    return root, far, bad


def _paths(parent: np.ndarray, far: np.ndarray, bad: np.ndarray, names: list[str]) -> list[str]:
    """Path from the block's root down to each node, '' for those on or below a cycle."""
    out = [""] * len(names)
    for i in np.argsort(far, kind="stable").tolist():
        if not bad[i]:
            p = parent[i]
            out[i] = names[i] if p < 0 else out[p] + SLASH + names[i]
    return out


def _blocks(forest: DataFrame, with_path: bool) -> DataFrame:
    """Contract each partition of (conversation_id, block, node_id, parent_id, steps, trail).

    Gives conversation_id, node_id, root_id, depth (to the block's root), cyclic, outside (the parent of a block root that is
    not in the block), steps and trail of that link, and path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        mark = pa.scalar("\x00")
        block = pc.cast(t["block"], pa.string())
        node = pc.binary_join_element_wise(t["conversation_id"], block, t["node_id"], mark)
        up = pc.binary_join_element_wise(t["conversation_id"], block, t["parent_id"], mark)
        node, up = node.combine_chunks(), up.combine_chunks()
        at = pc.index_in(up, value_set=node)
        parent = np.where(pc.is_null(t["parent_id"]).to_numpy(zero_copy_only=False), -1, pc.fill_null(at, -1).to_numpy(zero_copy_only=False)).astype(np.int64)
        steps = t["steps"].to_numpy()
        root, far, bad = contract(parent, steps)
        outside = pc.if_else(pa.array(parent < 0), t["parent_id"], pa.scalar(None, pa.string()))
        roots = pc.if_else(pa.array(bad), pa.scalar(""), pc.take(t["node_id"], pa.array(root)))
        if with_path:
            names = t["node_id"].to_pylist()
            trail = t["trail"].to_pylist()
            # A contracted link stands for several nodes; its trail names those between.
            path = pa.array(_paths(parent, _level(parent, bad), bad, [n if p < 0 or not s else s + SLASH + n for n, s, p in zip(names, trail, parent.tolist())]), pa.string())
        else:
            path = pa.nulls(t.num_rows, pa.string())
        out = pa.table(
            [t["conversation_id"], t["node_id"], roots, pa.array(np.where(bad, -1, far), pa.int64()), pa.array(bad), outside, t["steps"], t["trail"], path],
            names=["conversation_id", "node_id", "root_id", "depth", "cyclic", "outside", "steps", "trail", "path"],
        )
        yield from out.to_batches(max_chunksize=20_000)

    schema = "conversation_id string, node_id string, root_id string, depth bigint, cyclic boolean, outside string, steps bigint, trail string, path string"
    return forest.select("conversation_id", "block", "node_id", "parent_id", "steps", "trail").mapInArrow(run, schema)


def _level(parent: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Links to the block's root, whatever they weigh."""
    return contract(parent, np.ones(len(parent), dtype=np.int64))[1]


def _distributed_rounds(forest: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Rake and compress (conversation_id, node_id, parent_id, steps, trail) until no thread exceeds ``limit``.

    Gives what is left, the removals by round, the roots that lost all below them, and the nodes that a cycle shrank to.
    """
    log: list[DataFrame] = []
    retired: list[DataFrame] = []
    cores: list[DataFrame] = []
    turn = 0
    while forest.groupBy("conversation_id").count().where(F.col("count") > limit).limit(1).count():
        turn += 1
        degree = forest.where("parent_id IS NOT NULL").groupBy("conversation_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"), F.min("node_id").alias("child"))
        core = F.expr("parent_id = node_id OR (children = 1 AND parent_id = child)")
        f = forest.join(degree, _KEY, "left").withColumn("core", F.coalesce(core, F.lit(False)))
        f = materialize(f.withColumn("parent_id", F.when(~F.col("core"), F.col("parent_id"))), "contract")
        cores.append(f.where("core").select(*_KEY))
        retired.append(f.where("children IS NULL AND parent_id IS NULL").select(*_KEY))
        log.append(f.where("children IS NULL AND parent_id IS NOT NULL").select(*_KEY, "parent_id", "steps", "trail"))
        # Unary nodes on heads whose parent is no such node are spliced out; the parent of a leaf waits for the next round.
        coin = F.pmod(F.xxhash64("conversation_id", "node_id", F.lit(turn)), F.lit(2)) == 0
        inner = f.where("children IS NOT NULL")
        unary = inner.where((F.col("children") == 1) & F.col("parent_id").isNotNull() & coin)
        leaves = f.where("children IS NULL").select("conversation_id", F.col("node_id").alias("child"))
        unary = unary.join(leaves, ["conversation_id", "child"], "left_anti")
        beside = unary.select("conversation_id", F.col("node_id").alias("parent_id"))
        spliced = materialize(unary.join(beside, ["conversation_id", "parent_id"], "left_anti").select(*_KEY, "parent_id", "steps", "trail", "child"), "splice")
        log.append(spliced.drop("child"))
        bridge = spliced.select("conversation_id", F.col("child").alias("node_id"), F.col("node_id").alias("between"), F.col("parent_id").alias("over"), F.col("steps").alias("more"), F.col("trail").alias("before"))
        kept = inner.select(*_KEY, "parent_id", "steps", "trail").join(spliced.select(*_KEY), _KEY, "left_anti").join(bridge, _KEY, "left")
        # A core became a root in this round; the link that is bridged is then gone.
        over = F.col("between").isNotNull() & F.col("parent_id").isNotNull()
        forest = materialize(
            kept.select(
                *_KEY,
                F.when(over, F.col("over")).otherwise(F.col("parent_id")).alias("parent_id"),
                (F.col("steps") + F.when(over, F.col("more")).otherwise(0)).alias("steps"),
                F.when(over, F.concat_ws(SLASH, "before", "between", "trail")).otherwise(F.col("trail")).alias("trail"),
            ),
            "forest",
        )
    return forest, log, retired, cores


def _replay(labels: DataFrame, removed: DataFrame) -> DataFrame:
    """Labels with those of removed nodes, whose parents are labelled."""
    above = labels.select("conversation_id", F.col("node_id").alias("parent_id"), "root_id", "depth", "cyclic", "path")
    more = removed.join(above, ["conversation_id", "parent_id"]).select(
        *_KEY, "root_id", F.when(F.col("cyclic"), -1).otherwise(F.col("depth") + F.col("steps")).alias("depth"), "cyclic", F.when(F.col("cyclic"), F.lit("")).otherwise(F.concat_ws(SLASH, "path", "trail", "node_id")).alias("path")
    )
    return labels.unionByName(more)


def label_forest(links: DataFrame, with_path: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conversation_id, node_id, root_id, depth, cyclic, path) of every node of ``links`` (conversation_id, node_id, parent_id).

    Links hold each node once. A null parent, or one that is no node of the thread, makes a root of depth 0. Nodes on a cycle or
    below one have root_id '', depth -1 and path ''. Depth of trees is unbounded.
    """
    links = links.select(*_KEY, "parent_id", F.lit(1).cast("bigint").alias("steps"), F.lit(None).cast("string").alias("trail"))
    sizes = links.groupBy("conversation_id").count().where(F.col("count") > block_rows)
    large = {r["conversation_id"]: r["count"] for r in sizes.collect()}  # at most all rows / block_rows threads
    # So many tasks that one holds about a block, whatever the session's default.
    tasks = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-links.count() // BLOCK_ROWS))
    if not large:
        whole = links.withColumn("block", F.lit(0)).repartition(tasks, "conversation_id")
        return _blocks(whole, with_path).select(*_KEY, "root_id", "depth", "cyclic", "path")
    counts = F.broadcast(links.sparkSession.createDataFrame([(c, -(-n // block_rows)) for c, n in large.items()], "conversation_id string, blocks long"))
    split = links.join(counts, "conversation_id", "left")
    split = split.withColumn("block", F.coalesce(F.pmod(F.xxhash64("node_id"), F.col("blocks")), F.lit(0))).repartition(tasks, "conversation_id", "block")
    labels = materialize(_blocks(split, with_path).join(counts, "conversation_id", "left"), "blocks")
    whole = labels.where("blocks IS NULL").select(*_KEY, "root_id", "depth", "cyclic", "path")
    parts = labels.where("blocks IS NOT NULL").drop("blocks")
    # Block roots point into other blocks: to the root of the node they point to.
    met = parts.select("conversation_id", F.col("node_id").alias("outside"), F.col("root_id").alias("up"), F.col("depth").alias("more"), F.col("cyclic").alias("lost"), F.col("path").alias("way"))
    tops = parts.where("NOT cyclic AND node_id = root_id").select(*_KEY, "outside", "steps").join(met, ["conversation_id", "outside"], "left")
    tops = materialize(tops, "tops")
    lost = tops.where("lost").select(*_KEY, F.lit("").alias("root_id"), F.lit(-1).cast("bigint").alias("depth"), F.lit(True).alias("cyclic"), F.lit("").alias("path"))
    # Trail of a link: what the other block's path has below its root.
    below = F.expr("substring(way, length(up) + 2)") if with_path else F.lit(None).cast("string")
    forest = tops.where("lost IS NULL OR NOT lost").select(*_KEY, F.col("up").alias("parent_id"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.nullif(below, F.lit("")).alias("trail"))
    core, log, retired, cores = _distributed_rounds(materialize(forest, "forest"), block_rows)
    done = _blocks(core.withColumn("block", F.lit(0)).repartition(tasks, "conversation_id"), with_path).select(*_KEY, "root_id", "depth", "cyclic", "path")
    for r in retired:
        done = done.unionByName(r.select(*_KEY, F.col("node_id").alias("root_id"), F.lit(0).cast("bigint").alias("depth"), F.lit(False).alias("cyclic"), F.col("node_id").alias("path")))
    for c in cores:
        found = c.select("conversation_id", F.col("node_id").alias("root_id"), F.lit(True).alias("shrunk"))
        done = done.join(found, ["conversation_id", "root_id"], "left")
        dead = F.col("cyclic") | F.col("shrunk").isNotNull()
        done = done.select(*_KEY, F.when(dead, "").otherwise(F.col("root_id")).alias("root_id"), F.when(dead, -1).otherwise(F.col("depth")).alias("depth"), dead.alias("cyclic"), F.when(dead, "").otherwise(F.col("path")).alias("path"))
    done = materialize(done, "core")
    for removed in reversed(log):
        done = materialize(_replay(done, removed), "replay")
    done = done.unionByName(lost)
    high = done.select("conversation_id", F.col("node_id").alias("root_id"), F.col("root_id").alias("top"), F.col("depth").alias("more"), F.col("cyclic").alias("lost"), F.col("path").alias("way"))
    rest = parts.where("NOT cyclic").join(high, ["conversation_id", "root_id"]).select(
        *_KEY,
        F.col("top").alias("root_id"),
        F.when(F.col("lost"), -1).otherwise(F.col("depth") + F.col("more")).alias("depth"),
        F.col("lost").alias("cyclic"),
        F.when(F.col("lost"), F.lit("")).otherwise(F.concat("way", F.expr("substring(path, length(root_id) + 1)"))).alias("path"),
    )
    return whole.unionByName(rest).unionByName(parts.where("cyclic").select(*_KEY, "root_id", "depth", "cyclic", "path"))


def thread_links(mapping: DataFrame, parsed: DataFrame) -> DataFrame:
    """Each node once, with its parent: (conversation_id, node_id, parent_id).

    Nodes are those of ``mapping`` and, in threads without rows there, the messages of ``parsed``. The parent is the one a row
    names (of copies, the largest), or else the smallest of the nodes whose children list it. Rows without conversation_id or
    node_id are left out.
    """
    named = mapping.select("conversation_id", "node_id", F.col("parent").alias("named"), F.lit(None).cast("string").alias("lister"), F.lit(True).alias("node"))
    listed = mapping.select("conversation_id", F.explode("children").alias("child"), "node_id").select(
        "conversation_id", F.col("child").alias("node_id"), F.lit(None).cast("string").alias("named"), F.col("node_id").alias("lister"), F.lit(False).alias("node")
    )
    threads = mapping.select("conversation_id").distinct()
    others = parsed.where("record_type = 'message'").join(threads, "conversation_id", "left_anti")
    others = others.select("conversation_id", F.col("message_id").alias("node_id"), F.col("parent_id").alias("named"), F.lit(None).cast("string").alias("lister"), F.lit(True).alias("node"))
    rows = named.unionByName(listed).unionByName(others).where("conversation_id IS NOT NULL AND node_id IS NOT NULL")
    once = rows.groupBy(*_KEY).agg(F.max("named").alias("named"), F.min("lister").alias("lister"), F.max("node").alias("node")).where("node")
    return once.select(*_KEY, F.coalesce("named", "lister").alias("parent_id"))


def hierarchy(mapping: DataFrame, parsed: DataFrame, with_path: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Root, depth and (if asked for) path of each node of the threads; see ``thread_links`` and ``label_forest``."""
    return label_forest(materialize(thread_links(mapping, parsed), "links"), with_path, block_rows)


def descendants(labels: DataFrame) -> DataFrame:
    """(conversation_id, node_id, descendant_id): each node below another, from labels with paths of ids without ``SLASH``."""
    up = labels.where("NOT cyclic AND depth > 0").select("conversation_id", F.col("node_id").alias("descendant_id"), F.explode(F.slice(F.split("path", SLASH), 1, F.col("depth").cast("int"))).alias("node_id"))
    return up.select("conversation_id", "node_id", "descendant_id")


def _plain(id_: str) -> Column:
    """An id without ``SLASH``, from which ``_own`` gives the id again."""
    return F.expr(f"replace(replace({id_}, '%', '%25'), '{SLASH}', '%2F')").alias(id_)


def _own(id_: str) -> Column:
    return F.expr(f"replace(replace({id_}, '%2F', '{SLASH}'), '%25', '%')").alias(id_)


def all_descendants(mapping: DataFrame, parsed: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The pairs (conversation_id, node_id, descendant_id), and (conversation_id, node_id, descendants) with the number for every node.

    The ancestors of a node are read off its path, which the replay builds. Leaves, and nodes on or below a cycle, which have
    no path, are in no pair as node_id; their number is 0.
    """
    links = thread_links(mapping, parsed).select("conversation_id", _plain("node_id"), _plain("parent_id"))
    labels = materialize(label_forest(materialize(links, "links"), True, block_rows), "labels")
    pairs = descendants(labels).select("conversation_id", _own("node_id"), _own("descendant_id"))
    numbers = pairs.groupBy(*_KEY).agg(F.count("*").alias("descendants"))
    every = labels.select("conversation_id", _own("node_id")).join(numbers, _KEY, "left")
    return pairs, every.select(*_KEY, F.coalesce("descendants", F.lit(0)).alias("descendants"))
