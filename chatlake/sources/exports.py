"""Raw export files as one VARIANT per conversation.

A file may be JSON Lines, an array of conversations or one conversation, with or without a byte
order mark. Which of them is told for each file by its first character, and for objects by whether
the first line is one by itself, so the files of a folder may differ. JSON Lines are read line by
line and split across tasks, the other two file by file; arrays beyond ``WHOLE_BYTES`` are streamed
into JSON Lines in the shared folder first.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.errors import InputError
from chatlake.session import scratch_dir

#: Bytes of a file's beginning that tell its kind, and of the largest array that is read as one value.
HEAD, WHOLE_BYTES = 1 << 16, 512 << 20
#: Files whose beginnings are looked at together.
LOOKS = 32
#: Duplicate keys of an object: the last one wins.
_DUPLICATES = "spark.sql.variant.allowDuplicateKeys"


def sniff(head: str) -> str:
    """``array``, ``object`` or ``lines`` by the beginning of a file."""
    text = head.lstrip(chr(0xFEFF)).lstrip()
    if text.startswith("["):
        return "array"
    if text.startswith("{"):
        first, _, rest = text.partition("\n")
        if not rest.strip():
            # One line: the same either way.
            return "lines"
        try:
            json.loads(first)
        except ValueError:
            return "object"
        return "lines"
    return "lines"


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and length of each file at or under ``path`` (or a pattern), hidden ones left out, in order; the listing that any scan makes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    found = []
    for top in fs.globStatus(where) or ():
        listing = fs.listFiles(top.getPath(), True)
        while listing.hasNext():
            f = listing.next()
            if not f.getPath().getName().startswith(("_", ".")):
                found.append((f.getPath().toString(), f.getLen()))
    return sorted(found)


def _chunks(spark: SparkSession, path: str, size: int) -> Iterator[bytes]:
    """The bytes of a file on any file system, ``size`` at a time."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        while data := bytes(stream.readNBytes(size)):
            yield data
    finally:
        stream.close()


def kinds_of(spark: SparkSession, files: list[tuple[str, int]]) -> dict[str, str]:
    """Kind of each file by its beginning."""

    def look(path: str) -> tuple[str, str]:
        head = next(_chunks(spark, path, HEAD), b"").decode("utf-8", "ignore")
        # The first line of a longer file may go on beyond what was read; then it is taken for one record.
        return path, "lines" if len(head) >= HEAD // 4 and head.lstrip(chr(0xFEFF)).lstrip().startswith("{") and "\n" not in head.strip() else sniff(head)

    with ThreadPoolExecutor(LOOKS) as pool:
        return dict(pool.map(look, [p for p, _ in files]))


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.select("source", "line_no", F.col("value").alias("raw"), F.try_parse_json("value").alias("v"))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, line_no, raw, v) of JSON Lines: one row per line that is not blank; v is null where the line is no JSON."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.lit(None).cast("bigint").alias("line_no"), F.regexp_replace("value", r"^\x{FEFF}", "").alias("value"))
    return _parsed(rows.where(F.length(F.trim("value")) > 0))


def read_whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, line_no, raw, v) of files that are one array or one object; line_no is the element's position."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.regexp_replace("value", r"^\x{FEFF}", "").alias("value"))
    rows = rows.where(F.length(F.trim("value")) > 0).withColumn("v", F.try_parse_json("value"))
    array = F.try_variant_get("v", "$", "array<variant>").isNotNull()
    single = rows.where(F.col("v").isNull() | ~array).select("source", F.lit(0).cast("bigint").alias("line_no"), F.col("value").alias("raw"), "v")
    rows.where(array).select("source", "v").createOrReplaceTempView("_chatlake_whole")
    many = spark.sql("SELECT source, CAST(pos AS BIGINT) AS line_no, CAST(NULL AS STRING) AS raw, value AS v FROM _chatlake_whole, LATERAL variant_explode(v)")
    return single.unionByName(many)


def read_export(spark: SparkSession, path: str, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversations (source, line_no, v) and what is none (source, line_no, raw) of the files at ``path``.

    ``kind`` None looks at the beginning of every file. Values that are no object and texts that are no JSON are kept
    apart, so one bad record never fails a run. Empty files give no rows.
    """
    spark.conf.set(_DUPLICATES, "true")
    try:
        if kind is None:
            rows = _read_mixed(spark, path)
        else:
            rows = read_lines(spark, path) if kind == "lines" else read_whole(spark, path)
        rows.schema  # resolves the path
    except AnalysisException as e:
        raise InputError(f"cannot read {path}: {e.getCondition() or e}") from e
    good = F.try_variant_get("v", "$", "struct<_:variant>").isNotNull()
    return rows.where(good).select("source", "line_no", "v"), rows.where(~good).select("source", "line_no", "raw")


def _read_mixed(spark: SparkSession, path: str) -> DataFrame:
    files = _files(spark, path)
    if not files:
        raise InputError(f"no such file: {path}")
    kinds = kinds_of(spark, files)
    lines = [p for p, _ in files if kinds[p] == "lines"]
    large = [p for p, n in files if kinds[p] == "array" and n > WHOLE_BYTES]
    whole = [p for p, n in files if kinds[p] != "lines" and p not in set(large)]
    parts = [read_lines(spark, lines)] if lines else []
    if whole:
        parts.append(read_whole(spark, whole))
    for p in large:
        out = f"{scratch_dir(spark)}/array-{uuid.uuid4().hex}.jsonl"
        stream_array(spark, p, out)
        parts.append(read_lines(spark, out).withColumn("source", F.lit(p)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def discover(root: str, name: str = "parsed.jsonl") -> list[str]:
    """Paths of the thread files under ``root``, sorted."""
    base = Path(root)
    if not base.is_dir():
        raise InputError(f"no such folder: {root}")
    return sorted(map(str, base.rglob(name)))


def array_elements(chunks: Iterator[str], name: str = "the file") -> Iterator[str]:
    """The elements of a JSON array that comes in pieces, each as one line of JSON; memory is bounded by the largest element."""
    decoder, buffer, started = json.JSONDecoder(), "", False
    for more in _and_end(chunks):
        buffer += more
        if not started:
            buffer = buffer.lstrip(chr(0xFEFF)).lstrip()
            if not buffer and more:
                continue
            if not buffer.startswith("["):
                raise InputError(f"{name} is no JSON array")
            buffer, started = buffer[1:], True
        at = 0
        while True:
            at = _BETWEEN.match(buffer, at).end()
            if buffer.startswith("]", at):
                return
            try:
                value, end = decoder.raw_decode(buffer, at)
            except ValueError:
                break
            if end == len(buffer) and more:
                break  # a number may go on
            yield json.dumps(value, ensure_ascii=False)
            at = end
        buffer = buffer[at:]
    raise InputError(f"{name} ends inside its array")


_BETWEEN = re.compile(r"[\s,]*")


def _and_end(chunks: Iterator[str]) -> Iterator[str]:
    yield from chunks
    yield ""


def split_array_file(path: str, out: str, chunk: int = 1 << 20) -> int:
    """Rewrite a local file that is one large JSON array as JSON Lines, reading ``chunk`` characters at a time; gives the number of elements."""
    n = 0
    with open(path, encoding="utf-8-sig") as f, open(out, "w", encoding="utf-8") as g:
        for n, line in enumerate(array_elements(iter(lambda: f.read(chunk), ""), path), 1):
            g.write(line + "\n")
    return n


def stream_array(spark: SparkSession, path: str, out: str, chunk: int = 8 << 20) -> int:
    """``split_array_file`` from and to any file system."""
    import codecs

    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(out)
    target = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    n, held, size = 0, [], 0
    try:
        for n, line in enumerate(array_elements((decode(c) for c in _chunks(spark, path, chunk)), path), 1):
            held.append(line + "\n")
            size += len(line)
            if size > chunk:
                target.write(bytearray("".join(held).encode("utf-8", "surrogatepass")))
                held, size = [], 0
        target.write(bytearray("".join(held).encode("utf-8", "surrogatepass")))
    finally:
        target.close()
    return n
