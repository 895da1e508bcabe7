"""Suffix-array dedup of passages of MIN_WORDS words or more, bucket by bucket.

A suffix of a document (at each word) is put into the bucket of the smallest
GRAM-word hash among the grams of its first MIN_WORDS words, the leftmost if
tied. Suffixes that agree on MIN_WORDS words agree on that gram and on its
distance, so they lie in one bucket at one distance. Only buckets with two
occurrences of the gram in the corpus can hold a repeat; the text around the
others is never moved.

One bucket is sorted at a time. Its stretches of words are laid out so that
the gram starts at a multiple of PERIOD. Before sorting, the suffixes at the
positions of a difference cover modulo PERIOD get ranks to a depth beyond
MIN_WORDS, by doubling. A suffix is then sorted by its words up to the next
cover position (five at most) and the rank there; so ties of any length cost
one comparison and memory holds ranks for 4 of 13 positions only. Neighbours
in this order that agree on MIN_WORDS words are repeats, word by word.

A bucket of over CROWD occurrences (a licence in a third of all documents) isn't
held by one task. Its suffixes are grouped by the hash of their MIN_WORDS words,
combined before the shuffle; agreement on these words is all that the sorting
tells, so the result is the same.

Of each repeated stretch the occurrence with the smallest (doc_id, word) stays
and the others are reported; overlapping and adjoining ones of a document are
merged. Inside one document an occurrence that overlaps the one that stays is
left alone.

Defined cases: null and empty texts and texts under MIN_WORDS words have no
passages; rows without an id take no part; repeated rows of one id are one
document; an empty table gives an empty result; texts are read whole; other
columns are never read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import forget, id_text, lean, stored, text_of

MIN_WORDS = 50
GRAM = 14
#: Occurrences of a gram that one task sorts; those of a more frequent one are grouped by hash.
CROWD = 5000
PERIOD = 13
COVER = (0, 1, 3, 9)
_TO_COVER = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])


def anchors(w: W.Words, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix positions with ``least`` words, the anchor position of each, gram hashes at all words)."""
    gram, _ = w.grams(k)
    n = len(gram)
    end = np.repeat(w.doc_words[1:], np.diff(w.doc_words))
    ok = np.flatnonzero(np.arange(n) + least <= end)
    width = least - k + 1
    best = np.arange(n)
    step = 1
    while step * 2 <= width:
        right = best[np.minimum(np.arange(n) + step, n - 1)] if n else best
        best = np.where(gram[best] <= gram[right], best, right)
        step *= 2
    left, right = best[ok], best[ok + width - step]
    return ok, np.where(gram[left] <= gram[right], left, right), gram


def anchor_table(docs: DataFrame, least: int = MIN_WORDS, k: int = GRAM) -> DataFrame:
    """(gram, doc_id, at): the anchors of all suffixes."""

    def run(batches):
        for batch in batches:
            for first, part in W.passes(text_of(batch)):
                w = W.split(part)
                _, to, gram = anchors(w, least, k)
                at = np.unique(to)
                doc = np.searchsorted(w.doc_words, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[at].view(np.int64)), batch.column(0).take(pa.array(doc + first)), pa.array(at - w.doc_words[doc])], ["gram", "doc_id", "at"]
                )

    return id_text(docs).where("doc_id is not null").mapInArrow(lean(run), "gram long, doc_id long, at long")


def _with_lists(docs: DataFrame, met: DataFrame) -> DataFrame:
    """(doc_id, text, ats) of the documents that ``met`` (doc_id, at) names."""
    lists = met.groupBy("doc_id").agg(F.collect_set("at").alias("ats")).hint("merge")  # the lists grow with the documents
    return id_text(docs).join(lists, "doc_id").select("doc_id", "text", "ats")


def _wanted(w: W.Words, asked: pa.ListArray, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, first suffix, last suffix) of the asked anchors of a pass, and the gram hashes."""
    ok, to, gram = anchors(w, least, k)
    off = np.asarray(asked.offsets).astype(np.int64)
    row = np.repeat(np.arange(len(asked)), np.diff(off))
    at = np.asarray(asked.values)[off[0] : off[-1]] + w.doc_words[row]
    inside = at < w.doc_words[row + 1]  # another row of the same id may be shorter
    at, row = at[inside], row[inside]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    lo, hi = np.searchsorted(to, at, side="left"), np.searchsorted(to, at, side="right")
    has = hi > lo
    return row[has], at[has], ok[lo[has]], ok[hi[has] - 1], gram


def suffix_hashes(docs: DataFrame, met: DataFrame, least: int = MIN_WORDS, k: int = GRAM) -> DataFrame:
    """(hash, doc_id, at): the hash of the first ``least`` words of each suffix of the wanted anchors."""

    def run(batches):
        for batch in batches:
            for first, part in W.passes(text_of(batch)):
                w = W.split(part)
                row, _, lo, hi, _ = _wanted(w, batch.column(2).slice(first, len(part)), least, k)
                size = hi - lo + 1
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - lo, size)
                row = np.repeat(row, size)
                whole = w.grams(least)[0][at]
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), batch.column(0).take(pa.array(row + first)), pa.array(at - w.doc_words[row])], ["hash", "doc_id", "at"])

    return _with_lists(docs, met).mapInArrow(lean(run), "hash long, doc_id long, at long")


def crowded(docs: DataFrame, met: DataFrame, least: int, k: int) -> DataFrame:
    """(doc_id, word_at, word_to, kept_doc_id, kept_at) of repeats in crowded buckets ``met`` (doc_id, at)."""
    rows = stored(suffix_hashes(docs, met, least, k), "crowded-suffixes")
    place = F.struct("doc_id", "at")
    kept = rows.groupBy("hash").agg(F.min(place).alias("k"), F.max(place).alias("l")).where("k <> l").select("hash", F.col("k.doc_id").alias("kept_doc_id"), F.col("k.at").alias("kept_at"))
    gone = (F.col("doc_id") != F.col("kept_doc_id")) | (F.col("at") >= F.col("kept_at") + least)
    return rows.join(kept, "hash").where(gone).select("doc_id", F.col("at").alias("word_at"), (F.col("at") + least).alias("word_to"), "kept_doc_id", "kept_at")


def stretches(docs: DataFrame, met: DataFrame, least: int = MIN_WORDS, k: int = GRAM) -> DataFrame:
    """(gram, doc_id, start, at, words): the words that the suffixes of each wanted anchor reach over."""

    def run(batches):
        for batch in batches:
            wanted = batch.column(2)
            for first, part in W.passes(text_of(batch)):
                w = W.split(part)
                row, at, lo, hi, gram = _wanted(w, wanted.slice(first, len(part)), least, k)
                size = hi - lo + least
                bounds = np.concatenate(([0], np.cumsum(size)))
                index = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - lo, size)
                data = pa.py_buffer(w.hashes[index].tobytes())
                column = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer((bounds * 8).astype(np.int64).tobytes()), data]).cast(pa.binary())
                base = w.doc_words[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[at].view(np.int64)), batch.column(0).take(pa.array(row + first)), pa.array(lo - base), pa.array(at - base), column],
                    ["gram", "doc_id", "start", "at", "words"],
                )

    return _with_lists(docs, met).mapInArrow(lean(run), "gram long, doc_id long, start long, at long, words binary")


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples, the first key first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        s = key[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sort_bucket(bucket: np.ndarray, lead: np.ndarray, size: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort the suffixes of stretches of words.

    ``bucket``, ``lead`` (words before the anchor) and ``size`` are given for each
    stretch, ``words`` holds all stretches. Returns (stretch, place in the
    stretch, run) of all suffixes with ``least`` words, sorted; a run counts up
    where a suffix differs from its neighbour within ``least`` words.
    """
    n = len(size)
    # layout: the anchor of each stretch at a multiple of PERIOD
    pad = -lead % PERIOD
    room = (pad + size + PERIOD - 1) // PERIOD * PERIOD
    begin = np.concatenate(([0], np.cumsum(room)))[:-1] + pad
    total = int(room.sum())
    which = np.repeat(np.arange(n), size)
    spot = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
    text = np.zeros(total + PERIOD, np.int64)  # 0 stands for no word
    _, code = np.unique(words, return_inverse=True)
    text[begin[which] + spot] = code + 1
    end = np.zeros(total + PERIOD, np.int64)
    end[begin[which] + spot] = (begin + size)[which]
    # ranks of the cover's suffixes: first PERIOD words, then doubled
    sample = np.flatnonzero((text[:total] > 0) & np.isin(np.arange(total) % PERIOD, COVER))
    stop = end[sample]
    word = lambda d: np.where(sample + d < stop, text[np.minimum(sample + d, total)], 0)
    bits = max(1, int(len(code) + 1).bit_length())
    per = max(1, 63 // bits)
    keys = []
    for d in range(0, PERIOD, per):
        packed = np.zeros(len(sample), np.int64)
        for e in range(d, min(PERIOD, d + per)):
            packed = (packed << bits) | word(e)
        keys.append(packed)
    rank_at = np.full(total + PERIOD, -1, np.int64)
    rank = _dense(*keys)
    depth = PERIOD
    while depth < least:
        rank_at[sample] = rank
        after = np.where(sample + depth < stop, rank_at[np.minimum(sample + depth, total)], -1)
        rank = _dense(rank, after)
        depth *= 2
    rank_at[sample] = rank
    # suffixes: words up to the cover, then the rank there
    suffix = spot + least <= np.repeat(size, size)
    owner, place = which[suffix], spot[suffix]
    pos = begin[owner] + place
    far = _TO_COVER[pos % PERIOD]
    few = int(_TO_COVER.max())
    packed = [np.zeros(len(pos), np.int64) for _ in range(-(-few // per))]
    for d in range(few):
        packed[d // per] = (packed[d // per] << bits) | np.where(d < far, text[pos + np.minimum(d, far)], 0)
    tail = rank_at[pos + far]
    order = np.lexsort((tail, *packed[::-1], lead[owner] - place, bucket[owner]))
    owner, place, pos = owner[order], place[order], pos[order]
    new = np.ones(len(pos), bool)
    if len(pos):
        gap = (lead[owner] - place).astype(np.int64)
        same = (bucket[owner][1:] == bucket[owner][:-1]) & (gap[1:] == gap[:-1])
        check = np.flatnonzero(same)
        for d in range(least):  # word by word; pairs that differ drop out
            check = check[text[pos[check] + d] == text[pos[check + 1] + d]]
        new[check + 1] = False
    return owner, place, np.cumsum(new)


def _repeats(least: int):
    """Batches sorted by gram of (gram, doc_id, start, at, words) -> (doc_id, word_at, word_to, kept_doc_id, kept_at)."""
    names = ["doc_id", "word_at", "word_to", "kept_doc_id", "kept_at"]

    def solve(gram, doc, start, at, size, words):
        owner, place, run = sort_bucket(gram, at - start, size, words, least)
        d, s = doc[owner], start[owner] + place
        order = np.lexsort((s, d, run))
        d, s, run = d[order], s[order], run[order]
        first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else np.zeros(0, int)
        head = np.repeat(first, np.diff(np.append(first, len(run))))
        kd, ks = d[head], s[head]
        gone = (d != kd) | (s >= ks + least)
        d, s, kd, ks = d[gone], s[gone], kd[gone], ks[gone]
        order = np.lexsort((s, s - ks, kd, d))
        d, s, kd, ks = d[order], s[order], kd[order], ks[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (kd[1:] != kd[:-1]) | (s[1:] - ks[1:] != s[:-1] - ks[:-1]) | (s[1:] > s[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(d)) - 1 if len(a) else a
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (d[a], s[a], s[b] + least, kd[a], ks[a])], names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            gram = np.asarray(batch.column(0))
            cut = int(np.searchsorted(gram, gram[-1], side="left"))  # the last bucket may go on
            if cut:
                yield go([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield go(held)

    def go(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        gram, doc, start, at = (t.column(i).to_numpy() for i in range(4))
        flat = pa.concat_arrays([c.cast(pa.large_binary()) for c in t.column(4).chunks])
        off = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
        words = np.frombuffer(flat.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint64)
        return solve(gram, doc, start, at, np.diff(off) // 8, words)

    return run


def passages(docs: DataFrame, least: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, word_at, word_to, words, kept_doc_id): stretches of words that repeat an earlier one; ``kept_doc_id`` has the one that stays."""
    all_ = stored(anchor_table(docs, least, gram), "anchors")
    many = all_.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(all_.join(many.hint("merge"), "gram").select("doc_id", "at", "n"), "met-anchors")
    forget(all_)
    rows = stretches(docs, met.where(F.col("n") <= CROWD).select("doc_id", "at"), least, gram).repartition("gram").sortWithinPartitions("gram")
    found = rows.mapInArrow(lean(_repeats(least)), "doc_id long, word_at long, word_to long, kept_doc_id long, kept_at long")
    crowds = met.where(F.col("n") > CROWD).select("doc_id", "at")
    if not crowds.isEmpty():
        found = stored(found, "sorted").unionByName(crowded(docs, crowds, least, gram))
    before = Window.partitionBy("doc_id").orderBy("word_at", F.desc("word_to"), "kept_doc_id").rowsBetween(Window.unboundedPreceding, -1)
    island = Window.partitionBy("doc_id").orderBy("word_at", F.desc("word_to"), "kept_doc_id").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("new", F.when(F.col("word_at") <= F.max("word_to").over(before), 0).otherwise(1))
    found = found.withColumn("island", F.sum("new").over(island)).groupBy("doc_id", "island").agg(F.min("word_at").alias("word_at"), F.max("word_to").alias("word_to"), F.min("kept_doc_id").alias("kept_doc_id"))
    return found.select("doc_id", "word_at", "word_to", (F.col("word_to") - F.col("word_at")).alias("words"), "kept_doc_id")
