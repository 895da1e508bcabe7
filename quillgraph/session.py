"""Session settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; settings that are given win."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions or cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def shared_dir(spark) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    import re
    import tempfile

    name = "spark.checkpoint.dir"
    at = spark.sparkContext.getConf().get(name) or spark.conf.get(name, None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"{name} must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set(name, at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at.rstrip("/") or "/")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", whole)


def cut(df):
    """Checkpoint ``df`` reliably: lineage ends, and the rows survive lost executors."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def bucketed(df, key: str, parts: int):
    """``df`` as a table in the shared folder, in as many buckets by ``key`` as a shuffle has partitions: joins on it don't move its rows."""
    import uuid

    spark, name = df.sparkSession, f"quillgraph_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


#: Bytes of tables for each partition of a shuffle; a lineitem of so many has about 230,000 rows.
PARTITION_BYTES = 4 << 20
#: Bytes of a shuffle that a task gets at most where small partitions are joined; sorted in memory they are 5 to 40 times as many.
TASK_BYTES = 8 << 20


def fit(spark, *tables: str) -> None:
    """Let shuffles have partitions by the bytes of ``tables``, so that a task's memory doesn't grow with them; settings only become finer."""
    size = sum(int(spark.read.parquet(t)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for t in tables)
    name, advised = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(name, str(max(int(spark.conf.get(name)), -(-size // PARTITION_BYTES))))
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(advised))
    spark.conf.set(advised, str(min(now, TASK_BYTES)))


#: Rows up to which a side is broadcast by hint; a larger one is left to the planner.
BROADCAST_ROWS = 200_000


def small(df, rows: int = BROADCAST_ROWS):
    """``df`` with a broadcast hint if a bounded count shows that it is small."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sized(df, rows: int, most: int = BROADCAST_ROWS):
    """``df``, whose number of rows is known, with a broadcast hint if that is small."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows <= most else df


_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Give this package to the session's Python workers, once; they need it wherever they run."""
    import shutil
    import tempfile

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    root, name = os.path.split(here)
    if os.path.isdir(here):  # not when it runs from an archive, which Spark was given already
        at = shutil.make_archive(os.path.join(tempfile.mkdtemp(), name), "zip", root, name)
        spark.sparkContext.addPyFile(at)
    _SHIPPED.add(app)
