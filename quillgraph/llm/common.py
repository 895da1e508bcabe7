"""Shared folder, scans and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import ship

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset (tests, one machine) a folder of this process is set;
    on a cluster without the setting this raises, since no folder of one
    machine would do.
    """
    at = spark.sparkContext.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if at:
        path = spark._jvm.org.apache.hadoop.fs.Path(at.rstrip("/") or "/")
        whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return re.sub(r"^file:/+", "file:///", whole)
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
    spark.conf.set(_SETTING, at)
    spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage and survives lost executors.

    Spark removes the shuffle files of a finished job when the driver's
    collector finds that nothing holds them; it is run here, so that disks
    hold those of one step.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    spark._jvm.java.lang.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until ``df`` has no such column, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator reads, so that other columns can't clash."""
    ship(docs.sparkSession)
    q = lambda c: F.col(f"`{c}`")
    return docs.select(q(id_col).cast("long").alias("doc_id"), q(text_col).cast("string").alias("text"), *(q(c) for c in more))


def trim() -> None:
    """Give freed memory back to the system; workers live on between tasks, beside the JVM in one memory limit."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` for ``mapInArrow``, with freed memory given back after each batch that it has taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fed():
            for batch in batches:
                yield batch
                del batch
                trim()

        yield from fn(fed())

    return run


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.Table | pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one batch to any number of tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in fn(batch):
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(lean(run), schema)


def text_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column of a batch as large strings, nulls as empty."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``ids`` (doc_id); rows without an id stay.

    The ids grow with the documents, so both sides are sorted and merged, at every size.
    """
    name = fresh(docs, "gone")
    ids = ids.select(F.col("doc_id").alias(name)).hint("merge")
    return docs.join(ids, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids`` (doc_id); merged as in ``without_ids``."""
    name = fresh(docs, "stays")
    ids = ids.select(F.col("doc_id").alias(name)).hint("merge")
    return docs.join(ids, F.col("doc_id").cast("long") == F.col(name), "left_semi")


def row_hash(docs: DataFrame) -> Column:
    """The hash of all columns that picks one of several rows of an id."""
    return F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in docs.columns))


def once_per_id(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with one row for each of ``ids``, the ids that have several rows.

    Among them the row with the smallest hash of all columns stays. Where no
    id repeats this adds nothing to the plan.
    """
    if ids.isEmpty():
        return docs
    name = fresh(docs, "rank")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(row_hash(docs)))
    one = with_ids(docs, ids).withColumn(name, rank).where(F.col(name) == 1).drop(name)
    return without_ids(docs, ids).unionByName(one)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): connected components of (a, b), root the smallest node; by alternating large and small stars.

    Each round is written to the shared folder and the one before deleted.
    Rounds end when a round changes nothing. Nodes that are their own root are
    left out. The smallest neighbour comes from an aggregate, which combines
    before the shuffle, and joins back: a centre of very many edges is split
    among tasks.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = stored(large, name)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        after = stored(small, name)
        forget(now, large)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
