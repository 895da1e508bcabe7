"""Benchmark decontamination by a prefix-filtered set join.

A text of a benchmark item is the set of its shingles of SHINGLE words (one of
fewer words is one shingle of all its words). A document is contaminated by an
item if some window of as many words as one of the item's texts holds at least
SHARE of that text's shingles.

One scan of the documents finds where benchmark shingles occur. Their document
counts over the whole corpus order each item's shingles by rarity; a window
that reaches the share must hold one of the |I| - need + 1 rarest, so only
documents with such a prefix shingle, and with enough words, go on (length
bound). Only windows around a prefix shingle are looked at (positional bound),
and in these the distinct shingles are counted exactly.

The benchmark is sent to the executors in blocks of at most BLOCK shingles,
one scan for each block, so its size bounds nothing.

Defined cases: null or empty texts and items match nothing; each row of an
item_id is searched by itself, whatever its length, and repeated rows are one;
of several texts of an item, and of several documents of an id, the window with
the greatest share counts, then that with the most shingles, then the first;
documents and items without an id are left out of the result; an empty table
on either side gives an empty result; texts are read whole; other columns are
never read, so their names can't clash.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import id_text, lean, stored, text_of, without_ids

SHINGLE = 5
SHARE = 0.8
#: Shingles of the benchmark that one scan looks for: 8 bytes each, sent to every executor.
BLOCK = 2_000_000


def item_shingles(benchmark: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(part, item_id, gram, n, words, gram_words): the distinct shingles of each text (``part``) of an item."""

    def run(batches):
        for batch in batches:
            for at, part in W.passes(text_of(batch)):
                w = W.split(part)
                rows = []
                lengths = np.diff(w.doc_words)
                for size in sorted(set(np.minimum(lengths, k).tolist()) - {0}):
                    gram, ok = w.grams(size)
                    ok &= np.repeat(np.minimum(lengths, k) == size, lengths)
                    doc = w.doc_of_word[ok]
                    rows.append(np.unique(np.stack([doc, gram[ok].view(np.int64), np.full(len(doc), size), lengths[doc]]), axis=1))
                if rows:
                    doc, gram, size, length = np.concatenate(rows, axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(2).take(pa.array(doc + at)), batch.column(0).take(pa.array(doc + at)), pa.array(gram), pa.array(length), pa.array(size)], ["part", "item_id", "gram", "words", "gram_words"]
                    )

    items = id_text(benchmark, "item_id").where("doc_id is not null").dropDuplicates(["doc_id", "text"]).withColumn("part", F.xxhash64("doc_id", "text"))
    grams = items.mapInArrow(lean(run), "part long, item_id long, gram long, words long, gram_words long").distinct()
    return grams.withColumn("n", F.count("*").over(Window.partitionBy("part")))  # as many rows as one text has words


def occurrences(docs: DataFrame, grams: np.ndarray, sizes: list[int]) -> DataFrame:
    """(row, doc_id, doc_words, at, gram): where the given grams of the given sizes in words occur."""
    grams = np.sort(grams)
    bits = np.zeros(1 << 22, bool)
    bits[(grams & W.U64((1 << 22) - 1)).astype(np.int64)] = True

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, part in W.passes(text_of(batch)):
                w = W.split(part)
                lengths = np.diff(w.doc_words)
                for size in sizes:
                    g, ok = w.grams(size)
                    hit = np.flatnonzero(ok & bits[(g & W.U64((1 << 22) - 1)).astype(np.int64)])
                    hit = hit[grams[np.minimum(np.searchsorted(grams, g[hit]), len(grams) - 1)] == g[hit]]
                    doc = np.searchsorted(w.doc_words, hit, side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc + at + row), batch.column(0).take(pa.array(doc + at)), pa.array(lengths[doc]), pa.array(hit - w.doc_words[doc]), pa.array(g[hit].view(np.int64))],
                        ["row", "doc_id", "doc_words", "at", "gram"],
                    )
            row += len(batch)

    return id_text(docs).mapInArrow(lean(run), "row long, doc_id long, doc_words long, at long, gram long")


def _best_windows(batches):
    """Sorted (row, doc_id, part, item_id, n, span, at, gram, is_prefix) -> best window of each row and text of an item."""

    def best(at, gram, prefix, span):
        # windows start at an occurrence; count distinct shingles with two pointers
        count: dict[int, int] = {}
        to = marks = 0
        top, where = 0, 0
        for i, start in enumerate(at):
            while to < len(at) and at[to] <= start + span:
                count[gram[to]] = count.get(gram[to], 0) + 1
                marks += prefix[to]
                to += 1
            if marks and len(count) > top:
                top, where = len(count), start
            g = gram[i]
            marks -= prefix[i]
            if count[g] == 1:
                del count[g]
            else:
                count[g] -= 1
        return top, where

    def solve(rows):
        out = []
        row, doc, part, item, n, span, at, gram, prefix = rows
        key = list(zip(row, part, strict=True))
        cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                top, where = best(at[a:b], gram[a:b], prefix[a:b], span[a])
                out.append((doc[a], item[a], n[a], top, where))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "shingles", "matched", "word_at"])

    held = None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        rows = cols if held is None else [a + b for a, b in zip(held, cols, strict=True)]
        last = (rows[0][-1], rows[2][-1]) if rows[0] else None
        cut = len(rows[0])
        while cut and (rows[0][cut - 1], rows[2][cut - 1]) == last:
            cut -= 1
        held = [c[cut:] for c in rows]
        if cut:
            yield solve([c[:cut] for c in rows])
    if held is not None and held[0]:
        yield solve(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, matched, shingles, containment, word_at), a row for each contaminated id and item."""
    items = stored(item_shingles(benchmark, k), "items")
    keys = items.groupBy("gram").agg(F.min("gram_words").alias("size"))
    n = keys.count()
    blocks = max(1, math.ceil(n / BLOCK))
    found = []
    for b in range(blocks):
        part = keys.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == b).toPandas()
        if len(part):
            # each scan is written by itself: row numbers agree between scans, not between parts of a union
            found.append(stored(occurrences(docs, part["gram"].to_numpy(np.int64).view(np.uint64), sorted(set(part["size"]))), "occurrences"))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, matched long, shingles long, containment double, word_at long")
    found = reduce(DataFrame.unionByName, found)
    rarity = found.groupBy("gram").agg(F.countDistinct("row").alias("df"))
    need = F.ceil(F.col("n") * share - 1e-9)
    order = F.row_number().over(Window.partitionBy("part").orderBy("df", "gram"))
    ranked = items.join(rarity, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("rank", order).withColumn("need", need)
    ranked = ranked.withColumn("is_prefix", (F.col("rank") <= F.col("n") - F.col("need") + 1).cast("int"))
    ranked = stored(ranked.select("part", "item_id", "gram", "n", "need", "is_prefix", (F.col("words") - F.col("gram_words")).alias("span"), "gram_words"), "ranked")
    # length bound: a document needs room for the needed shingles
    met = found.join(ranked.where("is_prefix = 1"), "gram").where("doc_words >= least(need, span + 1) + gram_words - 1").select("row", "part").distinct()
    rows = found.join(ranked, "gram").join(met, ["row", "part"], "left_semi")
    rows = rows.select("row", "doc_id", "part", "item_id", "n", "span", "at", "gram", "is_prefix").repartition("row").sortWithinPartitions("row", "part", "at", "gram")
    best = rows.mapInArrow(lean(_best_windows), "doc_id long, item_id long, shingles long, matched long, word_at long")
    best = best.where(F.col("matched") >= F.ceil(F.col("shingles") * share - 1e-9)).where("doc_id is not null")
    share_of = (F.col("matched") / F.col("shingles")).alias("s")
    best = best.groupBy("doc_id", "item_id").agg(F.max(F.struct(share_of, "matched", (-F.col("word_at")).alias("w"), "shingles")).alias("b"))
    return best.select("doc_id", "item_id", "b.matched", "b.shingles", F.round(F.col("b.matched") / F.col("b.shingles"), 6).alias("containment"), (-F.col("b.w")).alias("word_at"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id isn't contaminated by any item."""
    return without_ids(docs, stored(contaminated(docs, benchmark).select("doc_id").distinct(), "contaminated"))


def sql(k: int = SHINGLE, share: float = SHARE) -> str:
    """The same in DuckDB."""
    words = r"regexp_extract_all(lower(coalesce(text, '')), '(?:[a-z0-9]|[^\x00-\x7F])+')"
    return f"""
WITH iw AS (SELECT row_number() OVER () AS part, item_id, ws FROM (SELECT DISTINCT item_id, {words} AS ws FROM benchmark WHERE item_id IS NOT NULL)),
ik AS (SELECT part, item_id, ws, least({k}, len(ws)) AS k FROM iw WHERE len(ws) > 0),
ig AS (SELECT part, item_id, k, len(ws) AS nw, unnest([array_to_string(ws[p:p + k - 1], ' ') for p in range(1, len(ws) - k + 2)]) AS gram FROM ik),
items AS (SELECT DISTINCT part, item_id, k, nw, gram FROM ig),
sized AS (SELECT *, count(*) OVER (PARTITION BY part) AS n FROM items),
dw AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents WHERE doc_id IS NOT NULL),
dg AS (SELECT r, doc_id, k, unnest([{{'p': p, 'g': array_to_string(ws[p:p + k - 1], ' ')}} for p in range(1, len(ws) - k + 2)]) AS u
       FROM dw, (SELECT DISTINCT k FROM ik) WHERE len(ws) >= k),
hits AS (SELECT r, doc_id, part, item_id, n, nw, sized.k, u.p AS p, gram FROM dg JOIN sized ON u.g = sized.gram AND dg.k = sized.k),
win AS (SELECT a.r, a.doc_id, a.part, a.item_id, a.n, a.p, count(DISTINCT b.gram) AS matched
        FROM (SELECT DISTINCT r, doc_id, part, item_id, n, nw, k, p FROM hits) a JOIN hits b
        ON a.r = b.r AND a.part = b.part AND b.p BETWEEN a.p AND a.p + a.nw - a.k GROUP BY ALL),
best AS (SELECT doc_id, item_id, arg_max({{'n': n, 'm': matched, 'p': p}}, (matched / n, matched, -p)) AS b FROM win WHERE matched >= ceil({share} * n - 1e-9) GROUP BY ALL)
SELECT doc_id, item_id, b.m AS matched, b.n AS shingles, round(b.m / b.n, 6) AS containment, b.p - 1 AS word_at FROM best"""
