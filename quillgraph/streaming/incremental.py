"""Streams of edge and node updates, merged into a store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import merges
from ..session import cut
from ..sources.graph import Graph
from ..sources.store import Store

EDGE_UPDATES = "src_uid string, dst_uid string, relation string, weight double, confidence double, source string, seq long"


def merge_edges(store: Store, batch: DataFrame, number: int) -> None:
    """Merge one batch. A batch that the store has already taken, after a restart, changes nothing."""
    if int(store.get_meta("edge_batch", -1)) >= number:
        return
    g = store.load()
    edges, _ = merges.upsert_edges(g.edges, batch, g.nodes)
    edges = cut(edges)
    ids = g.nodes.select("id", "uid")
    ends = batch.join(ids.select(F.col("uid").alias("src_uid"), F.col("id").alias("src")), "src_uid").join(ids.select(F.col("uid").alias("dst_uid"), F.col("id").alias("dst")), "dst_uid")
    nodes = merges.dirty_ends(g.nodes, ends.select("src", "dst"))
    store.save(Graph(nodes, edges, g.embeddings, g.pending), {"edge_batch": number})


def edge_stream(updates: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Start merging a stream of EDGE_UPDATES; the batch number makes each merge count once."""
    return updates.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: merge_edges(store, df, n)).start()
