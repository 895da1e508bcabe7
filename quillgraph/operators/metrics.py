"""Retrieval metrics over ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(returned: DataFrame) -> DataFrame:
    """(case_id, uid, rank): results of (case_id, uid, pos) without repeats, the first one counting."""
    first = returned.groupBy("case_id", "uid").agg(F.min("pos").alias("pos"))
    return first.select("case_id", "uid", F.row_number().over(Window.partitionBy("case_id").orderBy("pos", "uid")).alias("rank"))


def set_metrics(cases: DataFrame, returned: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, precision, recall, f1). Nothing returned: precision 0; nothing expected: recall 1."""
    got, want = returned.select("case_id", "uid").distinct(), expected.select("case_id", "uid").distinct()
    hit = got.join(want, ["case_id", "uid"], "left_semi").groupBy("case_id").agg(F.count("*").alias("hit"))
    n, m = got.groupBy("case_id").agg(F.count("*").alias("n")), want.groupBy("case_id").agg(F.count("*").alias("m"))
    all_ = cases.select("case_id").join(hit, "case_id", "left").join(n, "case_id", "left").join(m, "case_id", "left").fillna(0)
    p = F.when(F.col("n") == 0, 0.0).otherwise(F.col("hit") / F.col("n"))
    r = F.when(F.col("m") == 0, 1.0).otherwise(F.col("hit") / F.col("m"))
    out = all_.select("case_id", p.alias("precision"), r.alias("recall"))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def rank_metrics(cases: DataFrame, returned: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """(case_id, recall_at_k, mrr, ndcg) with ``expected`` (case_id, uid, gain); binary cases have gain 1."""
    want = expected.groupBy("case_id", "uid").agg(F.max("gain").alias("gain"))
    hits = ranked(returned).join(want, ["case_id", "uid"])
    found = hits.groupBy("case_id").agg(
        F.sum((F.col("rank") <= k).cast("int")).alias("hit"), (1.0 / F.min("rank")).alias("mrr"),
        F.sum(F.when(F.col("rank") <= k, F.col("gain") / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("gain"), "uid"))
    ideal = want.withColumn("place", place).groupBy("case_id").agg(
        F.count("*").alias("m"), F.sum(F.when(F.col("place") <= k, F.col("gain") / F.log2(F.col("place") + 1))).alias("best")
    )
    all_ = cases.select("case_id").join(found, "case_id", "left").join(ideal, "case_id", "left").fillna(0)
    recall = F.when(F.col("m") == 0, 1.0).otherwise(F.col("hit") / F.col("m"))
    ndcg = F.when(F.col("best") == 0, 0.0).otherwise(F.col("dcg") / F.col("best"))
    return all_.select("case_id", recall.alias("recall_at_k"), F.col("mrr").cast("double").alias("mrr"), ndcg.alias("ndcg"))


def averages(metrics: DataFrame) -> DataFrame:
    """Macro averages of all metric columns; 0 over no cases."""
    cols = [c for c in metrics.columns if c != "case_id"]
    return metrics.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in cols), F.count("*").alias("n"))
