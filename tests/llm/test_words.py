import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 .\né߀-", max_size=30)), max_size=8)


def plain(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7F])+", (text or "").lower())


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_split_and_count(texts):
    w = W.split(pa.array(texts, pa.string()))
    got = [[bytes(w.data[w.starts[i] : w.ends[i]]).decode() for i in range(w.doc_words[d], w.doc_words[d + 1])] for d in range(w.n_docs)]
    assert got == [plain(t) for t in texts]
    assert W.count(pa.array(texts, pa.string())).tolist() == [len(plain(t)) for t in texts]
    seen = {}
    for h, x in zip(w.hashes.tolist(), [x for t in got for x in t], strict=True):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_grams(texts, k):
    w = W.split(pa.array(texts, pa.string()))
    h, ok = w.grams(k)
    seen, at = {}, 0
    for t in texts:
        p = plain(t)
        for i in range(len(p)):
            assert ok[at] == (i + k <= len(p))
            if ok[at]:
                assert seen.setdefault(tuple(p[i : i + k]), h[at]) == h[at]
            at += 1
    assert len(set(seen.values())) == len(seen)


def test_passes_cover_all_rows():
    a = W.column(["x" * n for n in (0, 10, 5, 100, 0, 3)])
    parts = list(W.passes(a, 12))
    assert [x for _, p in parts for x in p.to_pylist()] == a.to_pylist()
    assert [at for at, _ in parts] == np.cumsum([0, *(len(p) for _, p in parts)])[:-1].tolist()
