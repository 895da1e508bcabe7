import random
import re

import numpy as np
import pytest

from quillgraph.llm import suffixes as S
from quillgraph.llm.common import table


def plain(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7F])+", (text or "").lower())


def brute(rows, least):
    """{doc: set of words that repeat an earlier window}."""
    first, gone = {}, {}
    for d, text in sorted((d, t) for d, t in rows if d is not None):
        w = plain(text)
        for s in range(len(w) - least + 1):
            key = tuple(w[s : s + least])
            at = first.setdefault(key, (d, s))
            if at[0] != d or s >= at[1] + least:
                gone.setdefault(d, set()).update(range(s, s + least))
    return gone


def covered(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.word_at, r.word_to))
        assert r.words == r.word_to - r.word_at
    for x in out.values():
        x.sort()
        assert all(a[1] < b[0] for a, b in zip(x[:-1], x[1:], strict=True))
    return {d: {k for a, b in x for k in range(a, b)} for d, x in out.items()}


def test_passages_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert covered(S.passages(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], S.MIN_WORDS)


@pytest.mark.parametrize("least,gram,seed", [(12, 4, 0), (30, 14, 1), (6, 2, 2)])
def test_small_alphabets(spark, least, gram, seed):
    rng = random.Random(seed)
    rows = []
    for d in range(60):
        w = [rng.choice("ab") if rng.random() < 0.9 else "c" for _ in range(rng.randint(0, 90))]
        if d % 3 == 0 and rows:
            w = w[:5] + plain(rows[-1][1]) + w[5:]
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert covered(S.passages(docs, least, gram)) == brute(rows, least)


def test_crowded_buckets_are_grouped_by_hash(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    for crowd in (1, 3):
        monkeypatch.setattr(S, "CROWD", crowd)
        assert covered(S.passages(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], S.MIN_WORDS)


def test_one_passage_in_very_many_rows(spark):
    head = " ".join(f"licence{i}" for i in range(60))
    docs = spark.range(200_000).selectExpr("id as doc_id", f"concat(id, ' own words ', id * 7, ' {head} then ', id * 13, ' ends') as text")
    got = S.passages(docs)
    assert got.count() == 199_999 and got.agg({"kept_doc_id": "max"}).first()[0] == 0 and got.agg({"words": "min"}).first()[0] == 61


def test_bucket_is_sorted_by_words():
    rng = np.random.default_rng(3)
    size = rng.integers(20, 60, 40)
    lead = rng.integers(0, 10, 40)
    bucket = rng.integers(0, 3, 40)
    words = rng.integers(0, 3, int(size.sum())).astype(np.uint64)
    owner, place, run = S.sort_bucket(bucket, lead, size, words, 20)
    at = np.cumsum(size) - size
    keys = [(bucket[o], lead[o] - p, tuple(words[at[o] + p : at[o] + p + 20])) for o, p in zip(owner, place, strict=True)]
    assert keys == sorted(keys) and len(keys) == int((size - 20 + 1).sum())
    assert [a != b for a, b in zip(keys[:-1], keys[1:], strict=True)] == (np.diff(run) > 0).tolist()


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = covered(S.passages(odd))
    assert got == brute(sorted({r for r in rows if r[0] is not None and r[0] != 8 and r[1]}), S.MIN_WORDS)
    assert {2, 6} <= set(got)
    assert S.passages(none).count() == 0
