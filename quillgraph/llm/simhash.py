"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has two halves of 64 bits, each a SimHash of a text's distinct
words. Two texts are near copies if their fingerprints are at most ``FAR`` bits
apart, and all such pairs are found: of FAR = 16 different bits the first half
holds at most 8 or the second at most 7. A half that differs in at most t bits
is cut into t + 3 blocks, of which three at least are equal: 165 choices of 3 of
11 blocks and 120 of 3 of 10. Sent are only the keys of the first equal block,
9 and 8 for each fingerprint; the choices of the other two are sorted within
the task that holds a block's value. The Hamming distance of whole fingerprints
decides.

Equal fingerprints are collapsed before blocking, so thousands of exact copies
cost one row; a crowded choice of blocks (``CROWD`` rows or more) is searched
outward from its members and yields a spanning forest, not all its pairs; of
the others each pair is sent once.

Defined cases: texts without words (null, empty, only marks) are compared
with nothing; rows without an id take no part; of several texts under one id
the one with the smallest fingerprint counts, and in ``deduplicated`` the row
that stays, that with the smallest hash; a tie of bits in a fingerprint
counts as 0; texts are read whole, whatever their length; an empty table gives
an empty result; other columns are carried along by ``deduplicated`` and only
hashed, so their names can't clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import arrow_map, components, fresh, id_text, lean, once_per_id, row_hash, stored, text_of, without_ids

FAR = 16
#: All pairs up to so many bits apart are found.
GUARANTEED = FAR
EQUAL = 3
#: Rows of one choice of blocks from which a spanning forest is made of them.
CROWD = 64
#: Members from which a crowd is searched at once.
FRONT = 16
#: Rows of whole keys that a task takes at once; a larger key is taken whole.
CHUNK = 1 << 17


def blocks(far: int) -> list[list[int]]:
    """Masks of the blocks of each half: of ``far`` different bits one half holds so few that EQUAL of its blocks are equal."""
    out = []
    for most in (far // 2, far - 1 - far // 2):
        ends = np.linspace(0, 64, most + EQUAL + 1).round().astype(int).tolist()
        out.append([(1 << b) - (1 << a) for a, b in zip(ends[:-1], ends[1:], strict=True)] if most >= 0 else [])
    return out


#: Choices of equal blocks in a half that holds half of FAR bits; the second half's are fewer and wider.
MASKS = [sum(chosen) for chosen in combinations(blocks(FAR)[0], EQUAL)]
_SIGNS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64) * 2 - 1
_LOW = W.U64((1 << 44) - 1)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n x 2 fingerprint halves, has words) of one pass of texts."""
    w = W.split(texts)
    n = w.n_docs
    key = np.sort((w.doc_of_word.astype(np.uint64) << W.U64(44)) | (w.hashes >> W.U64(20)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    doc = (key >> W.U64(44)).astype(np.int64) * 256
    out = np.zeros((n, 2), np.uint64)
    for half in range(2):
        h = W.mix((key & _LOW) + W.U64(0x5851F42D4C957F2D * (half + 1) % 2**64))
        octets = h.view(np.uint8).reshape(-1, 8)
        bits = [np.bincount(doc + octets[:, j], minlength=n * 256).reshape(n, 256) @ _SIGNS > 0 for j in range(8)]
        out[:, half] = np.packbits(np.concatenate(bits, axis=1), axis=1, bitorder="little").view(np.uint64).reshape(n)
    return out, np.diff(w.doc_words) > 0


def _by_id(docs: DataFrame, rank: str | None = None) -> DataFrame:
    """(doc_id, f0, f1, words, rows), one row for each id: of several that with the smallest ``rank``, or the smallest fingerprint of words."""

    def run(batch):
        ids = batch.column(0)
        for at, part in W.passes(text_of(batch)):
            f, has = fingerprints(part)
            f = f.view(np.int64)
            more = [batch.column(2).slice(at, len(part))] if rank else []
            yield pa.table([ids.slice(at, len(part)), pa.array(~has), f[:, 0].copy(), f[:, 1].copy(), *more], names)

    names = ["doc_id", "bare", "f0", "f1", *(["rank"] if rank else [])]
    rows = id_text(docs, "doc_id", "text", *([rank] if rank else [])).where("doc_id is not null")
    rows = arrow_map(rows, run, "doc_id long, bare boolean, f0 long, f1 long" + (", rank long" if rank else ""))
    first = F.min(F.struct(*(["rank"] if rank else []), "bare", "f0", "f1")).alias("f")
    return rows.groupBy("doc_id").agg(first, F.count("*").alias("rows")).select("doc_id", "f.f0", "f.f1", (~F.col("f.bare")).alias("words"), "rows")


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, f0, f1, rows), one row for each id that has words."""
    return _by_id(docs).where("words").drop("words")


def hamming(a0, a1, b0, b1) -> np.ndarray:
    return np.bitwise_count(a0 ^ b0).astype(np.int64) + np.bitwise_count(a1 ^ b1)


def _forest(ids: np.ndarray, f0: np.ndarray, f1: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the members of one key that are at most ``far`` apart.

    Trees grow side by side, so a front is held against all members that
    weren't in a front before: those not met yet and those met by other trees.
    """
    a, b = [], []
    left = np.arange(len(ids))  # not met yet
    met = left[:0]  # and not in a front yet
    tree = np.arange(len(ids))  # of each member, named by one of its members

    def link(x: int, y: int) -> None:
        p, q = tree[x], tree[y]
        if p != q:
            tree[tree == q] = p
            a.append(ids[x : x + 1])
            b.append(ids[y : y + 1])

    while len(left) or (tree[met[1:]] != tree[met[:-1]]).any():
        now, met = met[-FRONT:], met[:-FRONT]
        seeds, left = left[: FRONT - len(now)], left[FRONT - len(now) :]
        now = np.concatenate((now, seeds))
        near = hamming(f0[now][:, None], f1[now][:, None], f0[now], f1[now]) <= far
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            link(int(now[i]), int(now[j]))
        one = (tree[now] == tree[now[0]]).all()
        rest = np.concatenate((met[tree[met] != tree[now[0]]] if one else met, left))
        near = hamming(f0[now][:, None], f1[now][:, None], f0[rest], f1[rest]) <= far
        new = near[:, len(rest) - len(left) :]
        some = new.any(axis=0)
        hit, first = left[some], now[new[:, some].argmax(axis=0)]
        tree[hit] = tree[first]
        a.append(ids[first])
        b.append(ids[hit])
        met, left = np.concatenate((met, hit)), left[~some]
        i, j = np.nonzero(near)  # a member near to several trees joins them
        p, q = tree[now[i]], tree[rest[j]]
        across = np.flatnonzero(p != q)
        _, at = np.unique(p[across] * len(ids) + q[across], return_index=True)
        for k in across[at].tolist():
            link(int(now[i[k]]), int(rest[j[k]]))
    return np.concatenate(a or [ids[:0]]), np.concatenate(b or [ids[:0]])


def _edges_of_block(half: int, block: int, ids: np.ndarray, f: tuple[np.ndarray, np.ndarray], far: int, crowd: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges between rows whose first equal block of ``half`` is ``block``; the rows may hold several values of it."""
    cuts = [np.array(masks, np.uint64) for masks in blocks(far)]
    out = []

    def first_of(x: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether EQUAL blocks are equal, the masks of the first ones together) of differences x."""
        same = (x[:, None] & masks) == 0
        rank = same.cumsum(axis=1)
        return rank[:, -1] >= EQUAL, np.where(same & (rank <= EQUAL), masks, np.uint64(0)).sum(axis=1, dtype=np.uint64)

    for rest in combinations(cuts[half][block + 1 :], EQUAL - 1):
        mask = cuts[half][block] | np.bitwise_or.reduce(rest)
        key = f[half] & mask
        order = np.argsort(key)
        key = key[order]
        again = np.concatenate(([False], key[1:] == key[:-1]))
        if not again.any():
            continue
        start = np.flatnonzero(~again)
        size = np.diff(np.append(start, len(key)))
        for s, n in zip(start[size >= crowd].tolist(), size[size >= crowd].tolist(), strict=True):
            rows = order[s : s + n]
            out.append(_forest(ids[rows], f[0][rows], f[1][rows], far))
        many = np.flatnonzero((size > 1) & (size < crowd))
        left = size[many]
        at = np.arange(left.sum()) - np.repeat(np.cumsum(left) - left - start[many], left)
        left = np.repeat(start[many] + left, left) - at  # rows of the same key from here on
        for ahead in range(1, crowd):
            go = left > ahead
            at, left = at[go], left[go]
            if not len(at):
                break
            x, y = order[at], order[at + ahead]
            near = hamming(f[0][x], f[1][x], f[0][y], f[1][y]) <= far
            x, y = x[near], y[near]
            # the pair counts at the first of all choices at which it meets
            mine = first_of(f[half][x] ^ f[half][y], cuts[half])[1] == mask
            if half:
                mine &= ~first_of(f[0][x] ^ f[0][y], cuts[0])[0]
            out.append((ids[x[mine]], ids[y[mine]]))
    return out


def _edges_of_sorted(far: int, crowd: int = CROWD):
    """Iterator of batches sorted by key -> iterator of (a, b) edges; holds whole keys."""

    def solve(key, ids, f0, f1):
        kind = key >> 32
        first = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        found = [(ids[:0], ids[:0])]
        for s, e in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
            found += _edges_of_block(int(kind[s]) >> 8, int(kind[s]) & 255, ids[s:e], (f0[s:e], f1[s:e]), far, crowd)
        a, b = (np.concatenate([x[i] for x in found]) for i in range(2))
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches):
        held, rows, least = [], 0, CHUNK
        for batch in batches:
            held.append([np.array(batch.column(i)) for i in range(4)])
            rows += len(batch)
            if rows < least:
                continue
            cols = [np.concatenate(p) for p in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))  # the last key may go on in the next batch
            if cut:
                yield solve(*(c[:cut] for c in cols[:2]), *(c[:cut].view(np.uint64) for c in cols[2:]))  # as bits, without a sign
            held, rows = [[c[cut:].copy() for c in cols]], len(cols[0]) - cut
            least = max(CHUNK, 2 * rows)
        if rows:
            cols = [np.concatenate(p) for p in zip(*held, strict=True)]
            yield solve(*cols[:2], *(c.view(np.uint64) for c in cols[2:]))

    return run


def near_pairs(prints: DataFrame, far: int = FAR, crowd: int = CROWD) -> DataFrame:
    """(a, b): pairs of distinct fingerprints at most ``far`` bits apart; of crowds a spanning forest."""
    keys = []
    for half, masks in enumerate(blocks(far)):
        for block, mask in enumerate(masks[: len(masks) - EQUAL + 1]):
            low = (mask & -mask).bit_length() - 1
            value = F.shiftrightunsigned(f"f{half}", low).bitwiseAND(F.lit(mask >> low))
            keys.append(value + F.lit((half << 8 | block) << 32))
    keyed = prints.select(F.explode(F.array(*keys)).alias("key"), "doc_id", "f0", "f1")
    # so many tasks as are set: their work isn't told by their bytes
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(lean(_edges_of_sorted(far, crowd)), "a long, b long").distinct()


def groups(docs: DataFrame, far: int = FAR, rank: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, group_id, keep) of all groups of two or more documents, ids that have several rows).

    ``rank`` names a column of which the smallest value picks one of several rows of an id.
    """
    every = stored(_by_id(docs, rank), "fingerprints")
    prints = every.where("words").drop("words")
    # aggregates combine before the shuffle and join back, where a crowd of copies is split among tasks
    reps = stored(prints.groupBy("f0", "f1").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "representatives")
    roots = components(near_pairs(reps.select(F.col("rep").alias("doc_id"), "f0", "f1"), far), "near-pairs")
    labelled = reps.join(roots, reps.rep == roots.node, "left").select("f0", "f1", "rep", F.coalesce("root", "rep").alias("group_id"), "n")
    labelled = labelled.where((F.col("n") > 1) | (F.col("group_id") != F.col("rep"))).select("f0", "f1", "group_id")
    # a root without copies of its own has other members, or it wouldn't be a root
    alone = reps.where("n = 1").join(roots.select(F.col("root").alias("rep")).distinct(), "rep").select("f0", "f1", F.col("rep").alias("group_id"))
    out = prints.join(stored(labelled.unionByName(alone), "groups"), ["f0", "f1"])
    return out.select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("keep")), every.where("rows > 1").select("doc_id")


def deduplicated(docs: DataFrame, far: int = FAR) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id, and one row for each id."""
    rank = fresh(docs, "rank")
    found, repeated = groups(docs.withColumn(rank, row_hash(docs)), far, rank)
    gone = stored(found.where("not keep").select("doc_id"), "near-duplicates")
    return once_per_id(without_ids(docs, gone), repeated)
