"""Hybrid ranking of candidates by vector, centrality, confidence and recency."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small
from . import graphs, relational, vectors

SIGNALS = ("vector", "centrality", "confidence", "recency")


@dataclass(frozen=True)
class Weights:
    vector: float = 0.45
    centrality: float = 0.25
    confidence: float = 0.15
    recency: float = 0.15

    def shares(self) -> dict[str, float]:
        raw = {s: float(getattr(self, s)) for s in SIGNALS}
        total = sum(raw.values())
        if min(raw.values()) < 0 or total <= 0:
            raise ValueError("weights must not be negative, and not all zero")
        return {s: v / total for s, v in raw.items()}


def minmax(df: DataFrame, value: str, out: str) -> DataFrame:
    """Scale a column to [0, 1] over all rows; a range under 1e-12 gives 0.5."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    scaled = F.lit(0.5) if lo is None or hi - lo < 1e-12 else (F.col(value) - F.lit(lo)) / F.lit(hi - lo)
    return df.withColumn(out, scaled)


def corpus_clock(nodes: DataFrame) -> DataFrame:
    """(now): the latest ``mtime`` of any node."""
    return nodes.agg(F.max(F.expr("try_cast(get_json_object(attrs, '$.mtime') as double)")).alias("now"))


def mtimes(nodes: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, mtime): a node's own time, else its file's, else null."""
    own = F.expr("try_cast(get_json_object(attrs, '$.mtime') as double)")
    mine = nodes if ids is None else relational.by_ids(nodes, ids)
    files = nodes.where("type = 'file'").select(F.col("uid").alias("_file"), own.alias("_mtime"))
    rows = mine.select("id", own.alias("_own"), F.get_json_object("attrs", "$.file_uid").alias("_owner"))
    # few files own many nodes, so rows aren't gathered by owner if the files are few
    return rows.join(small(files), F.col("_owner") == F.col("_file"), "left").select("id", F.coalesce("_own", "_mtime").alias("mtime"))


def recency(now: float, half_life_days: float = 30.0):
    """exp(-age / half life); an unknown time gives 0.5, a time ahead counts as now. At the half life it is 1/e."""
    age = F.greatest(F.lit(0.0), (F.lit(float(now)) - F.col("mtime")) / 86400.0)
    # greatest() skips nulls, so an unknown time is told apart first
    return F.when(F.col("mtime").isNull(), 0.5).otherwise(F.exp(-age / F.lit(float(half_life_days))))


def within_budget(df: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """``df`` with ``run``, the costs of a key summed up in order, as far as they stay within ``budget``.

    Sums are taken in two steps, so a key that holds a great share of the rows
    isn't summed by one task: over ranges of the order, then inside them.
    """
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism * 4)
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // parts))
    piece = F.floor((F.col(order) - F.lit(lo or 0)) / F.lit(width)).alias("_piece")
    df = df.select("*", piece)
    sums = df.groupBy(key, "_piece").agg(F.sum(cost).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(key).orderBy("_piece")) - F.col("_sum")
    sums = sums.select(F.col(key).alias("_key"), F.col("_piece").alias("_p"), before.alias("_before")).where(F.col("_before") <= budget)
    rows = df.join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_piece") == F.col("_p")))
    run = F.col("_before") + F.sum(cost).over(Window.partitionBy(key, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("run", run).where(F.col("run") <= budget).drop("_key", "_p", "_piece", "_before")


def hybrid(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, candidates: DataFrame, query: list[float], depth: int = 2, weights: Weights | None = None, now: float | None = None, half_life_days: float = 30.0, prefer: str = "pagerank") -> DataFrame:
    """(id, score, vector, centrality, confidence, recency): best first, ties by id; signals are weighted parts of the score.

    Missing signals count as 0, recency as 0.5. Centrality is taken on the
    candidates expanded again by ``depth`` steps.
    """
    w = (weights or Weights()).shares()
    ids = candidates.select("id").distinct()
    if now is None:
        import time

        now = corpus_clock(nodes).first()["now"]
        now = time.time() if now is None else now
    central = ids.join(graphs.centrality_scores(nodes, edges, ids, depth, prefer=prefer), "id", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    out = (
        vectors.cosines(embeddings, ids, query)
        .join(minmax(central, "value", "c").select("id", "c"), "id", "left")
        .join(relational.mean_incident_confidence(edges, ids), "id", "left")
        .join(mtimes(nodes, ids).withColumn("r", recency(now, half_life_days)).select("id", "r"), "id", "left")
    )
    parts = {"vector": F.col("cosine"), "centrality": F.coalesce("c", F.lit(0.0)), "confidence": F.coalesce("confidence", F.lit(0.0)), "recency": F.coalesce("r", F.lit(0.5))}
    out = out.select("id", *((parts[s] * F.lit(w[s])).alias(s) for s in SIGNALS))
    score = F.col("vector") + F.col("centrality") + F.col("confidence") + F.col("recency")
    return out.select("id", score.alias("score"), *SIGNALS).orderBy(F.desc("score"), "id")
