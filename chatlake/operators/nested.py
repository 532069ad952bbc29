"""Problem 5: deeply nested records as flat tables with parent-child links.

Method: vectorised structural indexing. A batch of JSON texts is one byte buffer; bitmaps
of quotes, brackets and delimiters are built with numpy, string interiors follow from the
parity of quotes, the nesting depth is a prefix sum over brackets, and the spans of objects,
their containers and positions come from running maxima per depth.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of JSON text indexed at once; the index takes about forty times as much memory.
BUFFER = 1 << 20
#: What an object inside an array looks like; texts without it have no item and skip the index.
ITEM_AHEAD = r"[\[,]\s*\{"

_OPEN_OBJECT, _OPEN_ARRAY, _CLOSE_OBJECT, _CLOSE_ARRAY, _COMMA, _COLON, _QUOTE, _BACKSLASH = b"{[}],:\"\\"


class Spans:
    """The brackets of a buffer of valid JSON texts, in order, with their links."""

    def __init__(self, data: np.ndarray):
        at = np.arange(len(data), dtype=np.int64)
        slash = data == _BACKSLASH
        quote = data == _QUOTE
        if slash.any():
            # A quote is escaped if the run of backslashes before it has odd length.
            last_other = np.maximum.accumulate(np.where(slash, -1, at))
            run = np.concatenate(([0], (at - last_other)[:-1])) * np.concatenate(([False], slash[:-1]))
            quote &= run % 2 == 0
        inside = (np.cumsum(quote) & 1).astype(bool)
        opens = ((data == _OPEN_OBJECT) | (data == _OPEN_ARRAY)) & ~inside
        closes = ((data == _CLOSE_OBJECT) | (data == _CLOSE_ARRAY)) & ~inside
        marks = np.flatnonzero(opens | closes | (((data == _COMMA) | (data == _COLON)) & ~inside))
        kind = data[marks]
        up = opens[marks]
        down = closes[marks]
        depth = np.cumsum(up.astype(np.int32) - down.astype(np.int32))
        # Level of a bracket is the depth inside it; a delimiter stands at the depth of its container.
        level = depth + down
        n = len(marks)
        order = np.argsort(level, kind="stable")
        sorted_level = level[order]
        number = np.arange(n)
        starts = np.concatenate(([True], sorted_level[1:] != sorted_level[:-1])) if n else np.zeros(0, bool)
        # Within one level: the latest opener, and how many commas came since.
        is_open = up[order]
        latest = np.maximum.accumulate(np.where(is_open, number, -1))
        opener = np.full(n, -1, dtype=np.int64)
        opener[order] = np.where(latest >= 0, order[latest], -1)
        commas = np.cumsum(kind[order] == _COMMA)
        since = np.empty(n, dtype=np.int64)
        since[order] = commas - commas[np.maximum(latest, 0)]
        # The last mark of each level before a given one gives an opener its container, position and key.
        self.start = marks[up]
        self.is_object = kind[up] == _OPEN_OBJECT
        who = np.flatnonzero(up)
        index = np.full(n, -1, dtype=np.int64)
        index[who] = np.arange(len(who))
        ends = np.full(len(who), -1, dtype=np.int64)
        ends[index[opener[down]]] = marks[down]
        self.end = ends
        # A container of an opener at level L is the opener of the latest mark of level L - 1.
        parent = np.full(len(who), -1, dtype=np.int64)
        position = np.zeros(len(who), dtype=np.int64)
        colon = np.full(len(who), -1, dtype=np.int64)
        if n:
            bounds = np.append(np.flatnonzero(starts), n)
            levels = {int(sorted_level[b]): order[b:e] for b, e in zip(bounds[:-1], bounds[1:])}
            for lev, members in levels.items():
                own = members[up[members]]
                above = levels.get(lev - 1)
                if above is None or lev <= 1 or not len(own):
                    continue
                k = np.searchsorted(above, own) - 1
                before = above[np.maximum(k, 0)]
                i = index[own]
                parent[i] = index[opener[before]]
                position[i] = since[before]
                colon[i] = np.where(kind[before] == _COLON, marks[before], -1)
        self.parent, self.position, self.colon = parent, position, colon
        self.quotes = np.flatnonzero(quote)

    def key(self, raw: bytes, i: int) -> str:
        """Name of the field that holds bracket ``i``."""
        k = int(np.searchsorted(self.quotes, self.colon[i]))
        a, b = int(self.quotes[k - 2]), int(self.quotes[k - 1])
        text = raw[a + 1 : b]
        return json.loads(raw[a : b + 1]) if b"\\" in text else text.decode()


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def _valid(text: str) -> bool:
    """Whether ``text`` is JSON; NaN and Infinity are none."""
    try:
        json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False
    return True


def index_batch(texts: list[str]) -> tuple[list[int], list[str], list[str], list[str], list[int], list[str]]:
    """Items of valid JSON texts: number of the text, item path, parent item's path, table, position, body."""
    raw = "\n".join(texts).encode("utf-8", "surrogatepass")
    lengths = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(lengths)))
    s = Spans(np.frombuffer(raw, dtype=np.uint8))
    text_of = np.searchsorted(first, s.start, side="right") - 1
    path: list[str] = [""] * len(s.start)
    near: list[str] = [""] * len(s.start)  # path of the nearest item at or above the bracket
    table: list[str] = [""] * len(s.start)
    out: tuple = ([], [], [], [], [], [])
    objects, parents, positions, starts, ends = s.is_object.tolist(), s.parent.tolist(), s.position.tolist(), s.start.tolist(), s.end.tolist()
    of = text_of.tolist()
    for i, p in enumerate(parents):
        if p < 0:
            continue
        if objects[p]:
            name = s.key(raw, i)
            path[i] = f"{path[p]}.{name}" if path[p] else name
            table[i] = f"{table[p]}.{name}" if table[p] else name
            near[i] = near[p]
        else:
            path[i] = f"{path[p]}[{positions[i]}]"
            table[i] = f"{table[p]}[]"
            near[i] = near[p]
            if objects[i]:
                for column, value in zip(out, (of[i], path[i], near[p], table[i], positions[i], raw[starts[i] : ends[i] + 1].decode("utf-8", "replace"))):
                    column.append(value)
                near[i] = path[i]
    return out


def nested_items(records: DataFrame, id_col: str = "node_id", json_col: str = "message") -> DataFrame:
    """One row for each object that is an element of an array anywhere in a JSON text.

    Columns: ``node_id``, ``item_path`` (``a.b[0].c[2]``), ``parent_path`` (path of the nearest item around it, or ''),
    ``table_path`` (the item path with positions left out: the flat table the row belongs to), ``position``, ``body``
    (the object's own JSON text). Null, empty and invalid texts, and texts nested deeper than the parser allows, give no
    rows; a null id is kept; repeated records give repeated rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            chosen, size = [], 0
            for k, t in enumerate(batch.column(1).to_pylist()):
                if _valid(t):
                    chosen.append((ids[k], t))
                    size += len(t)
                if size > BUFFER:
                    yield emit(chosen)
                    chosen, size = [], 0
            if chosen:
                yield emit(chosen)

    def emit(chosen: list[tuple[str, str]]) -> pa.RecordBatch:
        of, *columns = index_batch([t for _, t in chosen])
        names = ["node_id", "item_path", "parent_path", "table_path", "position", "body"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([[chosen[i][0] for i in of], *columns], kinds)], names=names)

    rows = records.where(F.col(json_col).rlike(ITEM_AHEAD)).select(F.col(id_col).cast("string"), F.col(json_col))
    return rows.mapInArrow(run, "node_id string, item_path string, parent_path string, table_path string, position int, body string")


def item_links(records: DataFrame, id_col: str = "node_id", json_col: str = "message") -> DataFrame:
    """Distinct (node_id, item_path, parent_path) of ``nested_items``."""
    return nested_items(records, id_col, json_col).select("node_id", "item_path", "parent_path").distinct()
