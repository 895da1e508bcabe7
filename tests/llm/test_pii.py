import re

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import pii
from quillgraph.llm.common import table


@pytest.fixture(scope="module")
def model():
    return pii.fit(pii.labelled_table())


def slow_decode(model, scores, doc):
    out = np.zeros(len(scores), np.int64)
    for d in np.unique(doc):
        rows = np.flatnonzero(doc == d)
        best, back = scores[rows[0]] + model.moves[0], []
        for r in rows[1:]:
            options = best[:, None] + model.moves
            back.append(options.argmax(axis=0))
            best = options.max(axis=0) + scores[r]
        state = int((best + model.moves[:, 0]).argmax())
        path = [state]
        for b in back[::-1]:
            state = int(b[state])
            path.append(state)
        out[rows] = path[::-1]
    return out


def test_decoding_equals_plain_viterbi(model):
    rng = np.random.default_rng(0)
    for scale in (0.5, 3.0):
        scores = rng.normal(0, scale, (400, len(pii.TAGS))).astype(np.float32)
        scores[:, 0] += rng.choice([0, 30], 400)
        doc = np.sort(rng.integers(0, 25, 400))
        assert (model.decode(scores, doc) == slow_decode(model, scores, doc)).all()


def test_held_out_accuracy(model):
    t = pii.labelled_table(400, seed=99)
    texts = t.groupby("sentence")["token"].agg(" ".join).tolist()
    tok, _, _ = pii.tokens(pa.array(texts, pa.large_string()))
    got = model.decode(model.scores(tok), tok.doc)
    cored = [bool(re.search(r"[A-Za-z0-9+(\u0080-\U0010ffff]", x)) and bool(re.search(r"[A-Za-z0-9)\u0080-\U0010ffff]", x)) for x in t["token"]]
    want = t["tag"].map({x: k for k, x in enumerate(pii.TAGS)}).to_numpy()[cored]
    assert (got == want).mean() > 0.99
    for k in range(1, len(pii.TAGS)):
        assert (got[want == k] == k).mean() > 0.93, pii.TAGS[k]


def test_spans_of_the_table(spark, model):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    kinds = {"email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)", "card": r"(?<![\da-f])\d{16}(?![\da-f])", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}"}
    want = {(d, k, m.start(), m.end()) for d, t in text.items() for k, p in kinds.items() for m in re.finditer(p, t)}
    got = {tuple(r) for r in pii.find(docs, model).collect()}
    assert len(want) > 40
    assert len(got & want) >= 0.97 * len(want)
    assert len(got - want) <= 0.03 * len(want)


def test_contexts(model):
    texts = ["call +1 (383) 555-6083 ogn.33@mail1.example.com de 4738745156746829.", None, "", "é (366) 555-9807", "x 17.252.227.210### y", "...", "4111 1111 1111 1111"]
    doc, kind, a, b = pii.spans(pa.array(texts, pa.large_string()), model)
    got = [(int(d), pii.KINDS[k], texts[d][x:y]) for d, k, x, y in zip(doc, kind, a, b, strict=True)]
    assert got[:3] == [(0, "phone", "+1 (383) 555-6083"), (0, "email", "ogn.33@mail1.example.com"), (0, "card", "4738745156746829")]
    assert (3, "phone", "(366) 555-9807") in got and (4, "ip", "17.252.227.210") in got and (6, "card", texts[6]) in got


def test_odd_rows(odd, none, model):
    assert pii.find(odd, model).count() == 0
    assert pii.find(none, model).count() == 0
