"""Substring dedup: paragraph MinHash banding.

A text is cut in two ways, and each piece of either is a unit. Lines: the
words between line breaks. Segments: the words between content cuts, blind to
line breaks; a cut lies where the hash of a word triple is the smallest among
RADIUS words on both sides, so a passage that is repeated in the middle of
other lines is cut at the same words in all its places. Units of all lengths
take part. A passage of 50 words holds 36 places for a cut, one in 13 words
on average, and a segment lies between two.

The set of a unit's word triples gets a MinHash of bands of ROWS values, BANDS
for a line and SEGMENT_BANDS for a segment. At Jaccard similarity 0.75 a pair
of lines shares a band with probability 0.99, a pair of segments with 0.89, at
0.9 both with 0.995 or more. Units with the same words are one (by the hash of
all words) before banding; those of one or two words have no triple and meet
in this way only. Units that meet in a band are compared by the exact Jaccard
similarity of their triples; those of SIMILAR or more are joined, and clusters
are connected components. Of each cluster the unit with the smallest (doc_id,
word) stays and all others are repeats. Overlapping and adjoining repeats of a
document make one span, and spans of SPAN_WORDS or more are reported: shorter
repeats (a greeting, one line of a licence) occur in unrelated texts. This
bound is applied to joined spans only; ``least=1`` gives all.

Bands with the same members are searched once. A crowd of over CROWD units in
a band is searched in pairs of blocks, each outward from one unit at a time,
and yields spanning forests; so a passage in thousands of variants is held by
no task as a whole and costs no pairs.

Defined cases: null and empty texts have no units; rows without an id take no
part; repeated rows of one id are one document (a unit at one place counts
once); a repeat inside one document is reported, the first place stays; ties
can't occur, as places differ; an empty table gives an empty result; texts are
read whole; other columns are never read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import components, forget, id_text, lean, stored, text_of

SHINGLE = 3
RADIUS = 6
BANDS = 8
SEGMENT_BANDS = 4
ROWS = 3
SIMILAR = 0.75
SPAN_WORDS = 15
#: Units of one block of a crowded band; a task holds two blocks.
CROWD = 1000
#: Places for hashes of units that a task remembers, to send a unit's bands once; a later hash takes the place of an earlier one.
MEMORY = 1 << 20

_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_MUL = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_KIND = np.array([0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179], np.uint64)


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of x[i : i + width] for each i; beyond the end counts as the greatest."""
    top = np.uint64(2**64 - 1)
    step, out = 1, x
    while step * 2 <= width:
        out = np.minimum(out, np.concatenate((out[step:], np.full(min(step, len(x)), top))))
        step *= 2
    rest = width - step
    return np.minimum(out, np.concatenate((out[rest:], np.full(min(rest, len(x)), top)))) if rest else out


def content_cuts(w: W.Words, radius: int = RADIUS, k: int = SHINGLE) -> np.ndarray:
    """Words before which a text is cut; only those whose whole neighbourhood lies in the text."""
    gram, _ = w.grams(k)
    n = len(gram)
    if n <= 2 * radius:
        return np.zeros(0, np.int64)
    low = _lowest(gram, radius)
    size = np.diff(w.doc_words)
    begin, end = np.repeat(w.doc_words[:-1], size), np.repeat(w.doc_words[1:], size)
    i = np.arange(radius, n - radius)
    i = i[(i - radius >= begin[i]) & (i + radius + k <= end[i])]
    return i[(gram[i] < low[i - radius]) & (gram[i] <= low[i + 1])]  # of tied ones the first


class Units:
    """Lines and segments of one pass of texts, as ranges of words."""

    def __init__(self, texts: pa.Array):
        w = self.words = W.split(texts)
        n = len(w.hashes)
        whole = w.doc_words[:-1]
        starts = (np.searchsorted(w.starts, np.flatnonzero(w.data == 10)), content_cuts(w))
        both = [np.unique(np.concatenate((whole, s))) for s in starts]
        both = [s[s < n] for s in both]
        self.kind = np.repeat([0, 1], [len(s) for s in both])
        self.at = np.concatenate(both)
        self.to = np.concatenate([np.append(s[1:], n)[: len(s)] for s in both])
        # a text without words starts where the next one does, so it owns no unit
        self.doc = np.searchsorted(w.doc_words, self.at, side="right") - 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(w.hashes * W.powers(W._BASE, n), out=sums[1:])
        self.hash = W.mix((sums[self.to] - sums[self.at]) * W.powers(W._BASE_INV, n + 1)[self.at] + (self.to - self.at).astype(np.uint64) + _KIND[self.kind])

    def __len__(self) -> int:
        return len(self.at)

    def chars(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters of the text from the first word's start to the last word's end; lower case keeps their number."""
        w = self.words
        before = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum((w.data & 0xC0) != 0x80, out=before[1:])
        base = before[w.doc_bytes[self.doc]]
        return before[w.starts[self.at]] - base, before[w.ends[self.to - 1]] - base

    def shingles(self, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the shingles of the chosen units, n + 1 offsets); a unit of fewer words has none."""
        gram, _ = self.words.grams(SHINGLE)
        at, to = (self.at, self.to) if chosen is None else (self.at[chosen], self.to[chosen])
        size = np.maximum(to - at - SHINGLE + 1, 0)
        off = np.concatenate(([0], np.cumsum(size)))
        return gram[np.arange(off[-1]) - np.repeat(off[:-1] - at, size)], off

    def bands(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(band keys of the chosen units that have a shingle, the unit of each key)."""
        gram = (self.words.grams(SHINGLE)[0] >> W.U64(32)).astype(np.uint32)
        kinds = []
        for kind, bands in enumerate((BANDS, SEGMENT_BANDS)):
            mine = np.sort(chosen[(self.kind[chosen] == kind) & (self.to[chosen] - self.at[chosen] >= SHINGLE)])
            # reduceat takes [from, to) of each unit and of the gap behind it; the gaps are left out
            ends = np.stack((self.at[mine], self.to[mine] - SHINGLE + 1), axis=1).ravel()
            kinds.append((kind, bands, mine, ends, np.zeros((len(mine), bands), np.uint64)))
        for j in range(BANDS * ROWS):
            value = (gram ^ _XOR[j]) * _MUL[j]
            for kind, bands, mine, ends, out in kinds:
                if j < bands * ROWS and len(mine):
                    low = np.minimum.reduceat(value, ends)[::2].astype(np.uint64)
                    out[:, j // ROWS] = W.mix(out[:, j // ROWS] * W.U64(31) + low + W.U64(j // ROWS) + _KIND[kind])
        return np.concatenate([k[4].ravel() for k in kinds]), np.concatenate([np.repeat(k[2], k[1]) for k in kinds])


def unit_table(docs: DataFrame) -> DataFrame:
    """(doc_id, word_at, word_to, char_at, char_to, hash)."""

    def run(batches):
        for batch in batches:
            for first, part in W.passes(text_of(batch)):
                units = Units(part)
                base = units.words.doc_words[units.doc]
                cols = (units.at - base, units.to - base, *units.chars(), units.hash.view(np.int64))
                ids = batch.column(0).take(pa.array(units.doc + first))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in cols)], ["doc_id", "word_at", "word_to", "char_at", "char_to", "hash"])

    return id_text(docs).where("doc_id is not null").mapInArrow(lean(run), "doc_id long, word_at long, word_to long, char_at long, char_to long, hash long")


class Seen:
    """Hashes that a task has met lately, a place for each of MEMORY; a call costs as many steps as it brings hashes, however many were met."""

    def __init__(self, size: int = MEMORY):
        self.held = np.zeros(size, np.uint64)

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each of distinct ``hashes`` is new; one that another has displaced counts as new, and is sent again."""
        at = (hashes % W.U64(len(self.held))).astype(np.int64)
        new = self.held[at] != hashes
        new |= hashes == 0
        self.held[at] = hashes
        return new


def band_table(docs: DataFrame) -> DataFrame:
    """(key, hash) of the bands of units that have a shingle; a unit that a task has met lately isn't sent again."""

    def run(batches):
        seen = Seen()
        for batch in batches:
            for _, part in W.passes(text_of(batch)):
                units = Units(part)
                _, one = np.unique(units.hash, return_index=True)
                one = one[seen.add(units.hash[one])]
                keys, of = units.bands(np.sort(one))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(units.hash[of].view(np.int64))], ["key", "hash"])

    return id_text(docs).where("doc_id is not null").mapInArrow(lean(run), "key long, hash long")


def _met(batches):
    """Batches sorted by key and hash of (key, hash) -> (key, hash, place) of keys with several hashes; holds one row at a time."""
    key, hash_, place, sent = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, False  # the last row of the batch before
    for batch in batches:
        if not len(batch):
            continue
        keys = np.concatenate((key, np.asarray(batch.column(0))))
        hashes = np.concatenate((hash_, np.asarray(batch.column(1))))
        held = len(key) > 0
        once = np.concatenate(([True], (keys[1:] != keys[:-1]) | (hashes[1:] != hashes[:-1])))
        keys, hashes = keys[once], hashes[once]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(first, len(keys)))
        at = np.arange(len(keys)) - np.repeat(first, size)
        at[: size[0]] += place if held else 0
        out = (at > 0) | (np.repeat(size, size) > 1)
        go = out.copy()
        go[0] &= not (held and sent)
        key, hash_, place, sent = keys[-1:], hashes[-1:], int(at[-1]), bool(out[-1])
        yield pa.RecordBatch.from_arrays([pa.array(keys[go]), pa.array(hashes[go]), pa.array(at[go])], ["key", "hash", "place"])


def contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hash, shingles): sorted distinct shingles, as bytes, of the units ``wanted`` (doc_id, hash)."""
    lists = wanted.groupBy("doc_id").agg(F.collect_set("hash").alias("hashes")).hint("merge")  # the lists grow with the documents

    def run(batches):
        for batch in batches:
            for first, part in W.passes(text_of(batch)):
                units = Units(part)
                asked = batch.column(2).slice(first, len(part))
                off = np.asarray(asked.offsets).astype(np.int64)
                hashes = units.hash.view(np.int64)
                some = np.flatnonzero(np.isin(hashes, np.asarray(asked.values)[off[0] : off[-1]]))
                # any row that has a wanted unit may send it; of equal ones one counts
                _, one = np.unique(hashes[some], return_index=True)
                some = some[one]
                h, at = units.shingles(some)
                sets = [np.unique(h[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[some]), pa.array(sets, pa.binary())], ["hash", "shingles"])

    return id_text(docs).join(lists, "doc_id").select("doc_id", "text", "hashes").mapInArrow(lean(run), "hash long, shingles binary").dropDuplicates(["hash"])


def _pairs(off: np.ndarray, flat: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact Jaccard similarity of sets one[i] and two[i]; sets lie in ``flat`` with offsets, and have no repeats."""
    both = np.stack((one, two), axis=1).ravel()
    size = off[both + 1] - off[both]
    pair = np.repeat(np.arange(len(both)) // 2, size)
    value = flat[np.arange(len(pair)) - np.repeat(np.cumsum(size) - size - off[both], size)]
    order = np.lexsort((value, pair))
    pair, value = pair[order], value[order]
    common = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (value[1:] == value[:-1])], minlength=len(one))
    return common / np.maximum(size[::2] + size[1::2] - common, 1)


def _forest(off: np.ndarray, flat: np.ndarray, similar: float) -> list[tuple[int, int]]:
    """Spanning forest of sets that are ``similar`` by exact Jaccard; a set is held only against those that share a value with it."""
    n, size = len(off) - 1, np.diff(off)
    _, code = np.unique(flat, return_inverse=True)
    order = np.argsort(code, kind="stable")
    holder = np.repeat(np.arange(n), size)[order]
    start = np.searchsorted(code[order], np.arange(code.max() + 2 if n else 1))
    left, edges = np.ones(n, bool), []
    for seed in range(n):
        front = [seed] if left[seed] else []
        left[seed] = False
        while front and left.any():
            x = front.pop()
            mine = code[off[x] : off[x + 1]]
            many = start[mine + 1] - start[mine]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - start[mine], many)
            common = np.bincount(holder[at], minlength=n)
            hit = np.flatnonzero(left & (common >= similar * (size[x] + size - common))).tolist()
            edges += [(x, i) for i in hit]
            left[hit] = False
            front += hit
    return edges


def _verify(similar: float):
    """Batches sorted by group of (group, hash, shingles) -> (a, b); holds the sets of one batch and one group."""

    def solve(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        group, hashes = t.column(0).to_numpy(), t.column(1).to_numpy()
        sets = pa.chunked_array([c.cast(pa.large_binary()) for c in t.column(2).chunks]).combine_chunks()
        bounds = np.frombuffer(sets.buffers()[1], np.int64)[sets.offset : sets.offset + len(sets) + 1]
        flat = np.frombuffer(sets.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(np.uint64)
        off = (bounds - bounds[0]) // 8
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        count = np.diff(np.append(first, len(group)))
        two = first[count == 2]
        two = two[_pairs(off, flat, two, two + 1) >= similar] if len(two) else two
        a, b = [hashes[two]], [hashes[two + 1]]
        for f, n in zip(first[count > 2].tolist(), count[count > 2].tolist(), strict=True):
            edges = np.array(_forest(off[f : f + n + 1] - off[f], flat[off[f] : off[f + n]], similar), np.int64).reshape(-1, 2) + f
            a.append(hashes[edges[:, 0]])
            b.append(hashes[edges[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            group = np.asarray(batch.column(0))
            cut = int(np.searchsorted(group, group[-1], side="left"))  # the last group may go on
            if cut or (held and held[-1].column(0)[0].as_py() != group[0]):
                yield solve([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield solve(held)

    return run


def groups_to_search(met: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(group, hash): of bands with the same members one, cut into pairs of blocks of ``crowd`` units."""
    same = met.groupBy("key").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(hash))").alias("x"), F.expr("bit_xor(xxhash64(hash, 1))").alias("y"))
    one = same.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    block, blocks = F.floor(F.col("place") / crowd).cast("long"), F.ceil(F.col("n") / crowd).cast("long")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x != F.col("block")))
    met = met.join(one, "key").select("key", "hash", block.alias("block"), blocks.alias("blocks")).select("key", "hash", "block", F.explode(others).alias("other"))
    return met.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("group"), "hash")


def kept_places(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(hash, kept_doc_id, kept_at) of units with several places, alone or together with those similar to them.

    A unit has several places if its smallest and greatest differ, so repeated
    rows of an id don't count and nothing has to be sorted; both are combined
    before the shuffle.
    """
    place = F.struct("doc_id", "word_at")
    each = rows.groupBy("hash").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    each = stored(each.join(linked.hint("merge"), each.hash == linked.node, "left").where("root is not null or lo <> hi").select("hash", "root", "lo", "hi"), "places")
    whole = each.where("root is not null").groupBy("root").agg(F.min("lo").alias("low"))
    out = each.where("root is null").select("hash", "lo").unionByName(each.where("root is not null").join(whole, "root").select("hash", F.col("low").alias("lo")))
    return out.select("hash", F.col("lo.doc_id").alias("kept_doc_id"), F.col("lo.word_at").alias("kept_at"))


def removals(docs: DataFrame, similar: float = SIMILAR, least: int = SPAN_WORDS) -> DataFrame:
    """(doc_id, word_at, word_to, words, char_at, char_to, kept_doc_id): spans of at least ``least`` words that repeat; ``kept_doc_id`` has the copy that stays."""
    met = stored(band_table(docs).repartition("key").sortWithinPartitions("key", "hash").mapInArrow(lean(_met), "key long, hash long, place long"), "met")
    rows = stored(unit_table(docs), "units")
    wanted = rows.join(met.select("hash").distinct(), "hash").groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    sets = contents(docs, wanted)
    pairs = groups_to_search(met).join(sets, "hash").select("group", "hash", "shingles").repartition("group").sortWithinPartitions("group", "hash")
    roots = components(pairs.mapInArrow(lean(_verify(similar)), "a long, b long").distinct(), "similar")
    forget(met)
    kept = stored(kept_places(rows, roots), "kept")
    found = rows.join(kept, "hash").where("doc_id <> kept_doc_id or word_at <> kept_at").drop("hash", "kept_at")
    order = Window.partitionBy("doc_id").orderBy("word_at", F.desc("word_to"), "kept_doc_id")
    found = found.withColumn("new", F.when(F.col("word_at") <= F.max("word_to").over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    found = found.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = (F.min(c).alias(c) if c.endswith("at") or c.startswith("kept") else F.max(c).alias(c) for c in ("word_at", "word_to", "char_at", "char_to", "kept_doc_id"))
    found = found.groupBy("doc_id", "island").agg(*ends).withColumn("words", F.col("word_to") - F.col("word_at")).where(F.col("words") >= least)
    return found.select("doc_id", "word_at", "word_to", "words", "char_at", "char_to", "kept_doc_id")
