"""Incremental ingestion: files into nodes and edges, and the refresh of stale vectors."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import merges, relational
from ..session import cut
from ..sources import graph as G
from . import extract

CALLER = "python-ast"
log = logging.getLogger(__name__)


@dataclass
class Report:
    files_seen: int = 0
    files_indexed: int = 0
    files_skipped: int = 0
    files_deleted: int = 0
    nodes_upserted: int = 0
    edges_upserted: int = 0
    edges_unresolved: int = 0
    embedded: int = 0


def index(graph: G.Graph, files: DataFrame, force: bool = False, extractor: Callable[[DataFrame], DataFrame] = extract.extracted) -> tuple[G.Graph, Report]:
    """(graph after taking in ``files`` (path, content, sha256, mtime), counts).

    Files with the same hash are skipped unless forced. Files that are gone or
    changed lose their symbols, edges and pending rows, and what pointed at
    them is resolved again by the pending rows of other files.
    """
    files = files.persist()
    old = graph.nodes.where("type = 'file'").select(F.col("uid").alias("path"), F.get_json_object("attrs", "$.sha256").alias("was"))
    both = cut(files.select("path", "sha256").join(old, "path", "full_outer"))
    changed = both.where(F.col("sha256").isNotNull() & (F.lit(force) | F.col("was").isNull() | (F.col("was") != F.col("sha256")))).select("path")
    removed = both.where("sha256 is null").select("path")
    replaced = both.where(F.col("was").isNotNull()).select("path").join(changed.unionAll(removed), "path", "left_semi")
    report = Report(files_seen=files.count(), files_indexed=changed.count(), files_deleted=removed.count())
    report.files_skipped = report.files_seen - report.files_indexed
    if not report.files_indexed and not report.files_deleted:
        files.unpersist()
        return graph, report

    owner = F.get_json_object("attrs", "$.file_uid")
    old_names = graph.nodes.where("type <> 'file'").withColumn("path", owner).join(replaced, "path", "left_semi").select("name")
    nodes, edges, vectors, pending = merges.delete_files(graph.nodes, graph.edges, replaced.withColumnRenamed("path", "uid"), graph.embeddings, graph.pending)
    todo = files.join(changed, "path", "left_semi")
    rows = cut(extractor(todo))
    file_attrs = F.to_json(F.struct("sha256", "mtime", F.lit("python").alias("lang")))
    name = F.element_at(F.split("path", "/"), -1)
    file_nodes = todo.select(F.col("path").alias("uid"), F.lit("file").alias("type"), name.alias("name"), F.lit(None).cast("string").alias("body"), file_attrs.alias("attrs"), F.lit(0).alias("seq"))
    symbols = rows.where("what = 'node'").select("uid", "type", "name", "body", "attrs", F.col("place").alias("seq"))
    fill = {"id": G.node_id("uid"), "confidence": F.lit(1.0), "embed_dirty": F.lit(True), "source": F.lit(CALLER)}
    batch = file_nodes.unionByName(symbols).withColumns(fill)
    for c in ("valid_from", "valid_to"):
        batch = batch.withColumn(c, F.lit(None).cast("string"))
    # of repeated uids in a batch the first counts, as extractors come in order
    batch = cut(relational.keep_first(batch, "uid", "seq"))
    nodes = cut(merges.upsert_nodes(nodes.select(*[c.split()[0] for c in G.NODES.split(", ")]), batch))
    found = rows.where("what = 'edge'")
    head = lambda c: F.split(c, "::")[0]
    waiting = found.where(head("uid") != head("dst_uid")).select(
        F.col("uid").alias("src_uid"), F.col("file").alias("src_file"), F.element_at(F.split("dst_uid", r"::|\."), -1).alias("dst_name"), "relation", "confidence", "dst_uid", F.lit(CALLER).alias("source"), F.col("place").alias("seq")
    )
    pending = cut(merges.upsert_pending(pending, waiting))
    names = old_names.unionAll(batch.where("type <> 'file'").select("name")).distinct()
    mine = pending.join(changed.withColumnRenamed("path", "src_file"), "src_file", "left_semi").unionByName(pending.join(names.withColumnRenamed("name", "dst_name"), "dst_name", "left_semi")).distinct()
    resolved = cut(merges.resolve_pending(mine, nodes))
    direct = found.where(head("uid") == head("dst_uid")).select(F.col("uid").alias("src_uid"), "dst_uid", "relation", F.lit(1.0).alias("weight"), "confidence", F.lit(CALLER).alias("source"), F.col("place").alias("seq"))
    late = resolved.where("to_uid is not null").select("src_uid", F.col("to_uid").alias("dst_uid"), "relation", F.lit(1.0).alias("weight"), "confidence", F.coalesce("source", F.lit("by-name")).alias("source"), F.lit(2**31).alias("seq"))
    batch_edges = cut(direct.unionByName(late))
    merged, missing = merges.upsert_edges(edges, batch_edges, nodes)
    merged = cut(merged)
    ids = nodes.select("id", "uid")
    touched = batch_edges.join(ids.select(F.col("uid").alias("src_uid"), F.col("id").alias("src")), "src_uid").join(ids.select(F.col("uid").alias("dst_uid"), F.col("id").alias("dst")), "dst_uid")
    nodes = cut(merges.dirty_ends(nodes, touched.select("src", "dst")))
    report.nodes_upserted, report.edges_upserted = batch.count(), batch_edges.count() - missing.count()
    report.edges_unresolved = resolved.where("to_uid is null").count() + missing.count()
    files.unpersist()
    return G.Graph(nodes, merged, vectors, pending), report


def texts(nodes: DataFrame, edges: DataFrame, cap: int = 25) -> DataFrame:
    """(id, text): name and type, signature, first line of the docstring, then neighbours by relation."""
    path = F.coalesce(F.get_json_object("attrs", "$.file_uid"), F.when(F.col("uid").contains("::"), F.split("uid", "::")[0]))
    attr = lambda k: F.nullif(F.get_json_object("attrs", f"$.{k}"), F.lit(""))
    around = relational.relation_names(nodes, edges, cap).withColumn("line", F.concat("relation", F.lit(": "), F.concat_ws(", ", "names")))
    into = F.col("relation").endswith("_by")
    around = around.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(into.alias("i"), "relation", "line"))).alias("a"))
    head = F.concat(F.col("name"), F.lit("  ("), F.col("type"), F.coalesce(F.concat(F.lit(", "), path), F.lit("")), F.lit(")"))
    body = F.concat_ws(
        "\n", head, F.concat(F.lit("signature: "), attr("signature")), F.concat(F.lit("docstring: "), F.split(attr("docstring"), r"\R")[0]), F.concat_ws("\n", F.nullif(F.transform("a", lambda x: x["line"]), F.array().cast("array<string>")))
    )
    return nodes.join(around, "id", "left").select("id", body.alias("text"))


def hashing(dim: int = 256) -> Callable[[Column], Column]:
    return lambda c: T.hashing_embedding(c, dim)


def batched(embed: Callable[[list[str]], list], dim: int, size: int = 128) -> Callable[[Column], Column]:
    """A column function of an embedder of lists of texts, which gets ``size`` of them at once.

    A batch that raises, or gives too few vectors or some of another length, is
    tried once more; if that fails too its texts get null, so their nodes stay dirty.
    """

    def attempt(texts: list[str]) -> list:
        for _ in range(2):
            try:
                got = [[float(x) for x in v] for v in embed(texts)]
            except Exception as e:  # noqa: BLE001 - one bad batch must not end the job
                log.warning("embedder failed: %s", e)
                continue
            if len(got) == len(texts) and all(len(v) == dim for v in got):
                return got
        return [None] * len(texts)

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        whole = texts.fillna("").tolist()
        return pd.Series([v for k in range(0, len(whole), size) for v in attempt(whole[k : k + size])], dtype=object)

    return run


def refresh(graph: G.Graph, embed: Callable[[Column], Column], model: str | None = None, full: bool = False, serialize: Callable[[DataFrame, DataFrame], DataFrame] = texts) -> tuple[G.Graph, int]:
    """(graph with vectors for dirty, or all, nodes, how many); nodes whose text gets null stay as they were.

    ``serialize(nodes, edges)`` gives (id, text).
    """
    todo = graph.nodes if full else graph.nodes.where("embed_dirty")
    made = serialize(graph.nodes, graph.edges).join(todo.select("id"), "id", "left_semi")
    # filtered after the rows are written, so that no text is embedded twice
    batch = cut(made.select(F.col("id").alias("node_id"), embed(F.col("text")).alias("vector"), F.lit(model).cast("string").alias("model"))).where("vector is not null")
    vectors, nodes = merges.set_embeddings(graph.embeddings, batch, graph.nodes)
    return G.Graph(nodes, graph.edges, vectors, graph.pending), batch.count()
