"""Reference lookup, neighbourhoods, induced subgraphs and aggregates over edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, small

#: Ids up to which a lookup names them in its filter.
LITERALS = 100


def by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes whose id is in ``ids`` (id)."""
    return nodes.join(small(ids.select("id").distinct()), "id", "left_semi")


def by_uid(nodes: DataFrame, uid: str) -> DataFrame:
    return nodes.where(F.col("uid") == F.lit(uid)).select("id")


def symbol_exists(nodes: DataFrame, symbol: str) -> bool:
    """Is there a node, other than a file, with this name or uid?"""
    return not nodes.where(((F.col("name") == symbol) | (F.col("uid") == symbol)) & (F.col("type") != "file")).limit(1).isEmpty()


def references_to(nodes: DataFrame, edges: DataFrame, symbol: str) -> DataFrame:
    """Who points at nodes of this name or uid; files may be targets too."""
    target = nodes.where((F.col("name") == symbol) | (F.col("uid") == symbol)).select(F.col("id").alias("dst"), F.col("uid").alias("target_uid"))
    source = nodes.select(F.col("id").alias("src"), F.col("uid").alias("src_uid"), F.col("name").alias("src_name"), F.col("type").alias("src_type"))
    hits = edges.join(small(target), "dst").join(source, "src")
    return hits.select("src_uid", "src_name", "src_type", "relation", "confidence", "target_uid").orderBy(F.desc("confidence"), "src_uid", "relation", "target_uid")


def grouped_references(refs: DataFrame) -> DataFrame:
    """References of each target, in reference order."""
    item = F.struct((-F.col("confidence")).alias("c"), "src_uid", "relation")
    got = refs.groupBy("target_uid").agg(F.array_sort(F.collect_list(item)).alias("r"), F.count("*").alias("n"))
    return got.select("target_uid", "n", F.transform("r", lambda x: F.concat_ws("|", x["src_uid"], x["relation"])).alias("references"))


def neighborhood(nodes: DataFrame, edges: DataFrame, node: DataFrame) -> DataFrame:
    """(direction, relation, uid, name, confidence) one hop out of and into ``node`` (id)."""
    far = nodes.select(F.col("id").alias("far"), "uid", "name")
    few = [r.id for r in node.select("id").limit(LITERALS + 1).collect()]
    # literals reach the scan, and tables that can't hold them aren't read; repeated ids stay repeated
    at = lambda end: edges.where(F.col(end).isin(few)) if len(few) <= LITERALS else edges
    node = small(node.select("id"))
    out = at("src").join(node, F.col("src") == F.col("id")).select(F.lit("out").alias("direction"), "relation", F.col("dst").alias("far"), "confidence")
    into = at("dst").join(node, F.col("dst") == F.col("id")).select(F.lit("in").alias("direction"), "relation", F.col("src").alias("far"), "confidence")
    return out.unionByName(into).join(far, "far").select("direction", "relation", "uid", "name", "confidence").orderBy("direction", "relation", "name", "uid")


def induced_by_id(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids`` (id), in no order."""
    ids = small(ids.select("id").distinct())
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def induced(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``induced_by_id`` with uids for ids, strongest first."""
    inside = induced_by_id(edges, ids)
    label = by_ids(nodes, ids).select("id", "uid")
    got = inside.join(label.select(F.col("id").alias("src"), F.col("uid").alias("src_uid")), "src").join(label.select(F.col("id").alias("dst"), F.col("uid").alias("dst_uid")), "dst")
    return got.select(F.col("src_uid").alias("src"), F.col("dst_uid").alias("dst"), "relation", "weight", "confidence").orderBy(F.desc("confidence"), "src", "dst", "relation")


def mean_incident_confidence(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, confidence): mean over edges in and out; a loop counts once."""
    into = edges.select(F.col("dst").alias("id"), "confidence")
    out = edges.where("src <> dst").select(F.col("src").alias("id"), "confidence")
    both = into.unionByName(out)
    mean = F.avg("confidence").alias("confidence")
    if ids is None:
        return both.groupBy("id").agg(mean)
    if ids.select("id").limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return both.join(F.broadcast(ids.select("id")), "id", "left_semi").groupBy("id").agg(mean)
    # ids that can't be broadcast wait for sums, which are fewer than edges
    return both.groupBy("id").agg(mean).join(ids.select("id"), "id", "left_semi")


def strongest(edges: DataFrame) -> DataFrame:
    """One edge for each ordered pair: highest confidence, then smallest relation."""
    return edges.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"), F.min_by("relation", F.struct(-F.col("confidence"), "relation")).alias("relation"))


def relation_names(nodes: DataFrame, edges: DataFrame, cap: int = 25) -> DataFrame:
    """(id, relation, names): distinct neighbour names by relation, sorted, at most ``cap``; incoming ones are ``<relation>_by``."""
    name = nodes.select(F.col("id").alias("far"), F.col("name").alias("far_name"))
    out = edges.select(F.col("src").alias("id"), F.lower("relation").alias("relation"), F.col("dst").alias("far"))
    into = edges.select(F.col("dst").alias("id"), F.when(F.col("relation") == "CALLS", "called_by").otherwise(F.concat(F.lower("relation"), F.lit("_by"))).alias("relation"), F.col("src").alias("far"))
    # the smallest names by rank, so that a hub's names never sit in one row; one shuffle by id serves all that follows
    pairs = out.unionByName(into).join(name, "far").select("id", "relation", "far_name").repartition("id").distinct()
    rank = F.row_number().over(Window.partitionBy("id", "relation").orderBy("far_name"))
    return pairs.withColumn("k", rank).where(F.col("k") <= cap).groupBy("id", "relation").agg(F.array_sort(F.collect_list("far_name")).alias("names"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(what, n): the rows of each table."""
    each = [df.agg(F.lit(what).alias("what"), F.count("*").alias("n")) for what, df in tables.items()]
    return reduce(DataFrame.unionAll, each)


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the first by ``order``."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
