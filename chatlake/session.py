"""Session defaults and the few session-bound helpers the operators share."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "chatlake", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session in UTC with AQE; ``master`` None keeps what spark-submit gave."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    spark = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset (tests, one machine)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        # Remembered in the session, so repeated calls use one folder.
        d = spark.conf.get("chatlake.scratch.dir", None)
        if not d:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            d = tempfile.mkdtemp(prefix="chatlake-")
            spark.conf.set("chatlake.scratch.dir", d)
    return d.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted when the session's process ends."""
    path = f"{shared_dir(spark)}/chatlake-{spark.sparkContext.applicationId}"
    if path not in _made:
        _made.add(path)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(path)
        # Hadoop deletes it at the end of the JVM, whichever file system it is on.
        folder.getFileSystem(conf).deleteOnExit(folder)
    return path


_made: set[str] = set()


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that its functions run where it is not installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*")):
            if f.suffix in (".py", ".json", ".npz"):
                z.write(f, f.relative_to(package.parent))
    # Written by Hadoop, so the shared folder may be on any file system.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/chatlake.zip")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(data.getvalue())
    finally:
        out.close()
    spark.sparkContext.addPyFile(path.toString())


_shipped: set[str] = set()


def broadcast_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have at most ``most`` rows, otherwise as it is; for frames that are cheap to count."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
