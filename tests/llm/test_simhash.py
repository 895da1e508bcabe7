import numpy as np
import pytest

from quillgraph.llm import simhash
from quillgraph.llm.common import components, table


def closure(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_groups_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    p = simhash.fingerprint_table(docs).toPandas()
    f0, f1 = p["f0"].to_numpy().view(np.uint64), p["f1"].to_numpy().view(np.uint64)
    ids = p["doc_id"].to_numpy()
    d = simhash.hamming(f0[:, None], f1[:, None], f0[None], f1[None])
    near = lambda k: [(ids[i], ids[j]) for i, j in zip(*np.where(np.triu(d <= k, 1)), strict=True)]
    got = simhash.groups(docs)[0].toPandas()
    group = dict(zip(got["doc_id"], got["group_id"], strict=True))
    assert all(group[a] == group[b] for a, b in near(simhash.GUARANTEED))
    want = closure(near(simhash.FAR))
    assert group == want  # of all pairs that are near copies none is lost
    far = near(simhash.FAR)
    assert np.mean([group.get(a, a) == group.get(b, b) for a, b in far]) >= 0.9
    assert set(got[got["keep"]]["doc_id"]) == set(got["group_id"])
    assert (got["group_id"] <= got["doc_id"]).all()


def test_all_pairs_up_to_the_guarantee_share_a_key():
    rng = np.random.default_rng(0)
    for _ in range(300):
        flips = rng.choice(128, simhash.GUARANTEED, replace=False)
        x = [sum(1 << int(b - 64 * h) for b in flips if b // 64 == h) for h in range(2)]
        assert any(x[h] & m == 0 for h in range(2) for m in simhash.MASKS)


def test_each_choice_of_different_bits_leaves_equal_blocks():
    rng = np.random.default_rng(2)
    for far in (0, 1, 5, simhash.FAR):
        masks = simhash.blocks(far)
        assert all(sum(m) in (0, 2**64 - 1) for m in masks)
        for _ in range(300):
            flips = rng.choice(128, far, replace=False)
            x = [sum(1 << int(b - 64 * h) for b in flips if b // 64 == h) for h in range(2)]
            assert any(sum(x[h] & m == 0 for m in masks[h]) >= simhash.EQUAL for h in range(2))


@pytest.mark.parametrize("crowd", [2, simhash.CROWD])
def test_near_pairs_link_all_that_brute_force_links(spark, crowd):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, (400, 2), dtype=np.uint64)
    spread = np.uint64(sum(1 << (8 * b + 3) for b in range(8)))  # a bit of each byte: no two fingerprints share a byte
    twins = base[:100] ^ spread
    crowded = np.repeat(base[:1], 600, axis=0)
    for row in crowded:
        for bit in rng.choice(128, 12, replace=False).tolist():
            row[bit // 64] ^= np.uint64(1 << bit % 64)
    f = np.unique(np.concatenate((base, twins, crowded)), axis=0)
    d = simhash.hamming(f[:, None, 0], f[:, None, 1], f[None, :, 0], f[None, :, 1])
    want = [(int(i), int(j)) for i, j in zip(*np.where(np.triu(d <= simhash.FAR, 1)), strict=True)]
    rows = [(i, *r) for i, r in enumerate(f.view(np.int64).tolist())]
    got = [(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame(rows, "doc_id long, f0 long, f1 long"), crowd=crowd).collect()]
    assert (np.diag(d[[p[0] for p in got]][:, [p[1] for p in got]]) <= simhash.FAR).all() and closure(got) == closure(want)
    assert len(got) <= len(want) and (d == simhash.FAR).sum() >= 200


def test_crowded_key_gives_a_forest_of_the_whole_group():
    rng = np.random.default_rng(1)
    f0 = np.zeros(500, np.uint64) | (rng.integers(0, 64, 500).astype(np.uint64))
    a, b = simhash._forest(np.arange(500), f0, np.zeros(500, np.uint64), 6)
    assert len(a) == 499 and set(closure(zip(a.tolist(), b.tolist(), strict=True)).values()) == {0}


def test_forest_joins_trees_that_meet_late():
    # a path whose neighbours differ in 6 bits; its two halves grow from other members before the middle ones are met
    path = [(1 << 6 * k) - 1 for k in range(18)]
    path = [p for k, p in enumerate(path) if k not in (8, 9)] + path[8:10]
    f = np.array([[p & (2**64 - 1), p >> 64] for p in path], np.uint64)
    a, b = simhash._forest(np.arange(18), f[:, 0], f[:, 1], 6)
    assert len(a) == 17 and set(closure(zip(a.tolist(), b.tolist(), strict=True)).values()) == {0}


def test_clusters_that_meet_in_one_crowded_choice_only(spark):
    rng = np.random.default_rng(4)
    first, second = simhash.blocks(simhash.FAR)
    bits = lambda masks, k: sum((m & -m) << k for m in masks)
    # the two that join a pair of clusters differ in 8 blocks of each half, so 3 of the first and 2 of the second are equal
    middle = np.array([bits(first[3:], 0), bits(second[:8], 0)], np.uint64)
    to_a, to_b = (np.array([0, bits(second[:8], k)], np.uint64) for k in (1, 2))
    noise = [np.array([0, bits([m], 3) | bits([n], 4)], np.uint64) for m in second for n in second][:45]
    rows = []
    for x in rng.integers(0, 2**64, (10, 2), dtype=np.uint64):
        rows += [x, x ^ middle, *(x ^ to_a ^ n for n in noise), *(x ^ middle ^ to_b ^ n for n in noise)]
    f = np.stack(rows)[rng.permutation(len(rows))]
    d = simhash.hamming(f[:, None, 0], f[:, None, 1], f[None, :, 0], f[None, :, 1])
    want = closure([(int(i), int(j)) for i, j in zip(*np.where(np.triu(d <= simhash.FAR, 1)), strict=True)])
    rows = [(i, *r) for i, r in enumerate(f.view(np.int64).tolist())]
    got = closure((r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame(rows, "doc_id long, f0 long, f1 long")).collect())
    assert got == want and len(set(want.values())) == 10


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 199), (200, 199)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in closure(edges).items() if k != v}


def test_the_row_that_stays_is_the_one_compared(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    # two texts of one id, each with a copy under an id of its own, and an id with a text and an empty one
    rows = [r for k in range(0, 60, 3) for r in ((k, text(k)), (k, text(k + 1)), (k + 1, text(k)), (k + 2, text(k + 1)))]
    rows += [r for k in range(60, 80, 2) for r in ((k, text(k)), (k, ""), (k + 1, text(k)))]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = [r.text for r in kept if r.text]
    assert len({r.doc_id for r in kept}) == len(kept) and len(texts) == len(set(texts))
    assert set(texts) == {t for _, t in rows if t}  # one copy of each text is left


def test_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.group_id, r.keep) for r in simhash.groups(odd)[0].collect()}
    assert got == {(1, 1, True), (2, 1, False), (5, 5, True), (6, 5, False)}
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 7, 8, 9] and ids.count(None) == 2
    assert simhash.deduplicated(none).count() == 0
