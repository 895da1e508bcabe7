"""Mixing sources to target weights by cube-method balanced sampling.

Each document gets the inclusion probability that takes its source to its
target share of the token budget; a source too small for its share is taken
whole and the rest goes to the others. Flight: inside a source, fractional
probabilities move along the null space of the constraints (documents,
tokens) three at a time, until each move ends in a 0 or a 1; so the totals
of the sample stay at their expected values. This runs in parallel in blocks
of about BLOCK documents, then over what each block left (two documents at
most), until two at most are left in a source. Landing: these are drawn by
systematic sampling, with their probabilities and the nearest number of
documents.

Defined cases: a null source is a source of its own; rows without an id are
left out; several rows of one id are one unit with their words added, of the
smallest source among them; a document without words (null or empty text) has
the probability of its source; texts are counted whole; an empty table gives
an empty result; tied sizes move in pairs; other columns are carried along by
``mixed`` and never read, so their names can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import arrow_map, id_text, stored, text_of, with_ids

#: Share of all tokens that the mixture takes.
BUDGET = 0.85
#: Target weight of a source: its tokens to this power, normalised, if no weights are given.
POWER = 0.7
BLOCK = 20_000
#: Sources up to which their probabilities are broadcast (about 10 MB); of more, both sides are sorted and merged.
FEW_SOURCES = 100_000
SEED = 11


def token_table(docs: DataFrame) -> DataFrame:
    """(doc_id, mix_source, tokens), one row for each id; a null source is the empty name's neighbour '\\0'."""

    def run(batch):
        ids, names = batch.column(0), batch.column(2)
        for at, part in W.passes(text_of(batch)):
            yield pa.table([ids.slice(at, len(part)), names.slice(at, len(part)), W.count(part)], ["doc_id", "mix_source", "tokens"])

    d = id_text(docs, "doc_id", "text", "source").where("doc_id is not null")
    d = d.select("doc_id", "text", F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("mix_source"))
    rows = arrow_map(d, run, "doc_id long, mix_source string, tokens long")
    return rows.groupBy("doc_id").agg(F.min("mix_source").alias("mix_source"), F.sum("tokens").alias("tokens"))


def inclusion(sources: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``sources`` (mix_source, t, n, w) with p, its inclusion probability: min(1, level * w / t), with the level that spends the budget.

    The level rises while it fills further sources; each round is one
    aggregate, so nothing depends on the number of sources. A source without
    tokens has the budget itself.
    """
    goal = budget * float(sources.agg(F.sum("t")).first()[0] or 0)
    open_, level = sources.where("w > 0 and t > 0"), 0.0
    while goal > 1e-9:
        full = F.col("t") <= F.lit(level) * F.col("w")
        spent, weight = open_.agg(F.sum(F.when(full, F.col("t"))), F.sum(F.when(~full, F.col("w")))).first()
        if not weight:
            level = float("inf") if spent else level
            break
        new = max(0.0, goal - float(spent or 0)) / float(weight)
        if new <= level * (1 + 1e-12):
            break
        level = new
    p = F.when(F.col("t") <= 0, budget).when(F.col("w") <= 0, 0.0).when(F.lit(level) * F.col("w") >= F.col("t"), 1.0).otherwise(F.lit(level) * F.col("w") / F.col("t"))
    return sources.withColumn("p", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def flight(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: all but two at most are 0 or 1; sums of p and of p * tokens are kept."""
    p = p.astype(float).copy()
    todo = [int(i) for i in np.flatnonzero((p > 0) & (p < 1))][::-1]
    draws = rng.random(len(todo) * 3 + 3).tolist()
    active: list[int] = []
    q, t = p.tolist(), tokens.astype(float).tolist()
    while True:
        while len(active) < 3 and todo:
            active.append(todo.pop())
        if len(active) < 2:
            break
        if len(active) == 2:
            i, j = active
            if t[i] != t[j]:
                break
            u = (1.0, -1.0)
        else:
            i, j, k = active
            u = (t[j] - t[k], t[k] - t[i], t[i] - t[j])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            big = max(abs(x) for x in u)
            u = tuple(x / big for x in u)
        up = min((1 - q[a]) / x if x > 0 else q[a] / -x for a, x in zip(active, u, strict=False) if x)
        down = min(q[a] / x if x > 0 else (1 - q[a]) / -x for a, x in zip(active, u, strict=False) if x)
        step = up if draws.pop() * (up + down) < down else -down
        if not draws:
            draws = rng.random(64).tolist()
        rest = []
        for a, x in zip(active, u, strict=False):
            v = q[a] + step * x
            q[a] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
            if 0.0 < q[a] < 1.0:
                rest.append(a)
        active = rest
    return np.array(q)


def landing(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Systematic draw of what is still fractional."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    ends = np.cumsum(p[open_]) + rng.random()
    p = p.copy()
    p[open_] = np.diff(np.floor(np.concatenate(([ends[0] - p[open_][0]] if len(open_) else [], ends)))) if len(open_) else 0
    return p


def _fly(group: pd.DataFrame, land: bool, seed: int) -> pd.DataFrame:
    group = group.sort_values(["place", "doc_id"], kind="stable")
    name = f"{seed}|{land}|{group['mix_source'].iloc[0]}|{group['block'].iloc[0]}"
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big"))
    p = flight(group["p"].to_numpy(), group["tokens"].to_numpy(), rng)
    return group.assign(p=landing(p, rng) if land else p)


def _flight_of(land: bool, seed: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _fly(group, land, seed)

    return run


def drawn(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, probability) of the drawn documents; the null source is null."""
    base = stored(token_table(docs), "tokens")
    sources = base.groupBy("mix_source").agg(F.sum("tokens").cast("double").alias("t"), F.count("*").alias("n"))
    spark = docs.sparkSession
    if weights:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "mix_source string, w double")
        sources = sources.join(given, "mix_source", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    else:
        sources = sources.withColumn("w", F.pow(F.greatest(F.col("t"), F.lit(0.0)), F.lit(POWER)))
    plan = inclusion(stored(sources, "sources"), budget)
    plan = plan.select("mix_source", "p", F.greatest(F.lit(1), F.round(F.col("n") / BLOCK).cast("int")).alias("blocks"))
    plan = F.broadcast(plan) if plan.count() <= FEW_SOURCES else plan.hint("merge")
    units = base.join(plan, "mix_source").withColumn("place", F.xxhash64("doc_id", F.lit(seed)))
    units = units.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks").cast("long"))).drop("blocks")
    schema = "mix_source string, doc_id long, tokens long, p double, place long, block long, p0 double"
    units = units.withColumn("p0", F.col("p")).select("mix_source", "doc_id", "tokens", "p", "place", "block", "p0")
    sure = units.where("p <= 0 or p >= 1")
    flown = stored(units.where("p > 0 and p < 1").groupBy("mix_source", "block").applyInPandas(_flight_of(False, seed), schema), "flown")
    left = flown.where("p > 0 and p < 1").withColumn("block", F.lit(-1).cast("long"))
    # what blocks leave is two documents each; where a source has very many blocks, that flies again in blocks
    while (left.groupBy("mix_source").count().agg(F.max("count")).first()[0] or 0) > 10 * BLOCK:
        seed += 1
        again = left.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(1 + left.count() // BLOCK)))
        again = stored(again.groupBy("mix_source", "block").applyInPandas(_flight_of(False, seed), schema), "flown")
        flown = flown.where("p <= 0 or p >= 1").unionByName(again.where("p <= 0 or p >= 1"))
        left = again.where("p > 0 and p < 1").withColumn("block", F.lit(-1).cast("long"))
    landed = left.groupBy("mix_source").applyInPandas(_flight_of(True, seed), schema)
    out = sure.unionByName(flown.where("p <= 0 or p >= 1")).unionByName(landed).where("p >= 0.5")
    return out.select("doc_id", F.when(F.col("mix_source") != "\0", F.col("mix_source")).alias("source"), "tokens", F.round("p0", 6).alias("probability"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs`` that are drawn."""
    return with_ids(docs, stored(drawn(docs, weights, budget).select("doc_id"), "drawn"))
