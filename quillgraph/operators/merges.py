"""Upserts, deletes and pending edges as set operations on whole tables.

``seq`` is the order of arrival inside a batch; stored rows come before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small
from .vectors import normalized


def upsert_nodes(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Nodes after the batch (same columns and seq): the last of a uid replaces all columns, keeps the stored id, and is dirty."""
    cols = [c for c in stored.columns if c not in ("id", "uid", "embed_dirty")]
    old = stored.withColumn("seq", F.lit(-1).cast("long")).withColumn("fresh", F.lit(False))
    new = batch.withColumn("fresh", F.lit(True)).withColumn("seq", F.col("seq").cast("long"))
    both = old.unionByName(new, allowMissingColumns=True)
    last = F.max_by(F.struct(*cols), "seq").alias("last")
    got = both.groupBy("uid").agg(F.min_by("id", "seq").alias("id"), last, F.max("fresh").alias("changed"), F.max_by("embed_dirty", F.when(~F.col("fresh"), 0)).alias("was"))
    return got.select("id", "uid", *(F.col(f"last.{c}") for c in cols), (F.col("changed") | F.coalesce("was", F.lit(True))).alias("embed_dirty")).select(*stored.columns)


def upsert_edges(stored: DataFrame, batch: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges after the batch, rejected rows). Confidence only rises; weight and source are those of the first row that reached it.

    Stored edges have ids; batch rows have src_uid, dst_uid, relation, weight,
    confidence, source, seq. Rows without both nodes are rejected.
    """
    ids = nodes.select("id", "uid")
    a, b = (ids.select(F.col("uid").alias(f"{x}_uid"), F.col("id").alias(x)) for x in ("src", "dst"))
    missing = batch.join(a, "src_uid", "left").join(b, "dst_uid", "left").where("src is null or dst is null").select(*batch.columns)
    first = lambda order: F.min_by(F.struct("weight", "source"), order).alias("f")
    # rows of a pair meet once before they are placed; what waits is the first of each, with its place in the order
    order = F.struct((-F.col("confidence")).alias("c"), F.col("seq").cast("long").alias("seq"))
    each = batch.select("src_uid", "dst_uid", "relation", "weight", "source", "confidence", order.alias("o")).repartition("src_uid", "dst_uid", "relation")
    each = each.groupBy("src_uid", "dst_uid", "relation").agg(F.max("confidence").alias("confidence"), first("o"), F.min("o").alias("o"))
    placed = each.join(a, "src_uid").join(b, "dst_uid").select("src", "dst", "relation", "f.weight", "confidence", "f.source", "o")
    rows = stored.select("src", "dst", "relation", "weight", "confidence", "source", F.struct((-F.col("confidence")).alias("c"), F.lit(-1).cast("long").alias("seq")).alias("o")).unionByName(placed)
    merged = rows.groupBy("src", "dst", "relation").agg(F.max("confidence").alias("confidence"), first("o"))
    return merged.select("src", "dst", "relation", "f.weight", "confidence", "f.source"), missing


def dirty_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with both ends of ``edges`` (src, dst) marked dirty."""
    ends = small(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()).withColumn("_hit", F.lit(True))
    out = nodes.join(ends, "id", "left").withColumn("embed_dirty", F.col("embed_dirty") | F.col("_hit").isNotNull())
    return out.select(*nodes.columns)


def set_embeddings(stored: DataFrame, batch: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(embeddings, nodes) after writing unit vectors for (node_id, vector, model); their nodes are clean."""
    new = batch.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    new = new.select("node_id", F.size("vector").alias("dim"), normalized(F.col("vector")).alias("vector"), "model")
    kept = stored.join(new, "node_id", "left_anti").select("node_id", "dim", "vector", "model")
    done = new.select(F.col("node_id").alias("id")).distinct().withColumn("_done", F.lit(True))
    clean = nodes.join(done, "id", "left").withColumn("embed_dirty", F.col("embed_dirty") & F.col("_done").isNull()).select(*nodes.columns)
    return kept.unionByName(new), clean


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, embeddings: DataFrame | None = None, pending: DataFrame | None = None):
    """(nodes, edges, embeddings, pending) without ``files`` (uid), their symbols, and all that hangs on them; surviving neighbours are dirty."""
    names = small(files.select(F.col("uid").alias("_f")).distinct())
    owner = F.coalesce(F.get_json_object("attrs", "$.file_uid"), F.when(F.col("type") == "file", F.col("uid")))
    gone = nodes.withColumn("_f", owner).join(names, "_f", "left_semi").select("id")
    gone_edges = lambda e, x: e.join(gone.withColumnRenamed("id", x), x, "left_semi")
    far = gone_edges(edges, "src").select(F.col("dst").alias("id")).union(gone_edges(edges, "dst").select(F.col("src").alias("id"))).distinct()
    left = nodes.join(gone, "id", "left_anti").join(far.withColumn("_far", F.lit(True)), "id", "left")
    left = left.withColumn("embed_dirty", F.col("embed_dirty") | F.col("_far").isNotNull()).select(*nodes.columns)
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)
    vec = embeddings.join(gone.withColumnRenamed("id", "node_id"), "node_id", "left_anti") if embeddings is not None else None
    wait = pending.join(names, F.col("src_file") == F.col("_f"), "left_anti") if pending is not None else None
    return left, kept, vec, wait


def ordinal_uids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with ``uid``: the key, and for all but its first row by ``order`` its number after a #."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    name = F.when(F.col("_k") == 0, F.col(key)).otherwise(F.concat(key, F.lit("#"), F.col("_k").cast("string")))
    return rows.withColumn("_k", k).withColumn("uid", name).drop("_k")


def upsert_pending(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Pending edges after the batch (with seq): last file, highest confidence, last known target and source."""
    rows = stored.withColumn("seq", F.lit(-1).cast("long")).unionByName(batch.withColumn("seq", F.col("seq").cast("long")))
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    got = rows.groupBy("src_uid", "dst_name", "relation").agg(F.max_by("src_file", "seq").alias("src_file"), F.max("confidence").alias("confidence"), known("dst_uid"), known("source"))
    return got.select("src_uid", "src_file", "dst_name", "relation", "confidence", "dst_uid", "source")


def resolve_pending(pending: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pending`` with ``to_uid``: the exact target, or its package form, of a row that has one; else the only node, not a file, of that name; else null.

    A row with an exact target never falls back to the name.
    """
    names = nodes.where("type <> 'file'").groupBy(F.col("name").alias("dst_name")).agg(F.count("*").alias("n"), F.min("uid").alias("by_name")).where("n = 1").drop("n")
    uids = nodes.select(F.col("uid").alias("_u"))
    have = pending.withColumn("_want", F.coalesce("dst_uid", F.lit(None).cast("string")))
    package = F.when(F.col("dst_uid").rlike(r"^[^:]*\.py::"), F.regexp_replace("dst_uid", r"^([^:]*)\.py::", "$1/__init__.py::"))
    got = (
        have.withColumn("_package", package)
        .join(uids.withColumnRenamed("_u", "_exact"), F.col("_want") == F.col("_exact"), "left")
        .join(uids.withColumnRenamed("_u", "_init"), F.col("_package") == F.col("_init"), "left")
        .join(names, "dst_name", "left")
    )
    to = F.when(F.col("dst_uid").isNotNull(), F.coalesce("_exact", "_init")).otherwise(F.col("by_name"))
    return got.withColumn("to_uid", to).select(*pending.columns, "to_uid")
