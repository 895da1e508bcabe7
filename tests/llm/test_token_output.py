import json

import numpy as np

from quillgraph.llm import token_output as T
from quillgraph.llm.common import new_path, shared_dir, table


def check(spark, docs, folder):
    index = T.write(docs, folder).toPandas().sort_values(["shard", "position"])
    corpus = T.Corpus(folder)
    enc = T.encoder(T.VOCABULARY)
    got = []
    for n, r in enumerate(index.itertuples()):
        ids = corpus[n]
        assert len(ids) == r.tokens and ids[-1] == T.END_ID
        got.append((None if np.isnan(r.doc_id) else int(r.doc_id), enc.decode(ids[:-1].tolist())))
    assert len(corpus) == len(index)
    start = index["token_start"].to_numpy()
    assert (start == np.cumsum(index["tokens"]) - index["tokens"]).all()
    assert [int(corpus.shards[s][2][0]) for s in range(len(corpus.shards))] == [s["base"] for s in corpus.manifest["shards"]]
    return got


def test_round_trip(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").repartition(5, "doc_id")
    got = check(spark, docs, new_path(spark, "tokens"))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(((r.doc_id, r.text) for r in docs.collect()), key=key)


def test_odd_rows(spark, odd, none):
    got = check(spark, odd, new_path(spark, "tokens"))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=key)
    folder = new_path(spark, "tokens")
    assert T.write(none, folder).count() == 0
    assert len(T.Corpus(folder)) == 0


def test_files_are_flat_and_typed(spark, sf):
    folder = new_path(spark, "tokens")
    T.write(table(spark, sf, "documents"), folder)
    at = folder.removeprefix("file://")
    manifest = json.load(open(f"{at}/manifest.json"))
    assert manifest["dtype"] == "<u2"
    ids = np.fromfile(f"{at}/{manifest['shards'][0]['name']}.bin", "<u2")
    assert len(ids) == manifest["shards"][0]["tokens"] and (ids == T.END_ID).sum() == manifest["shards"][0]["documents"]


def test_other_pattern_engine_gives_the_same():
    import regex

    enc = T.encoder(T.VOCABULARY)
    text = "It's  a   test\n\n of 123 words, été!  "
    assert [i for m in regex.finditer(T.PATTERN, text) for i in enc._encode_single_piece(m.group())] == enc.encode_ordinary(text)
    assert enc.decode(T.encode(" " * 300_000 + "x", T.VOCABULARY)) == " " * 300_000 + "x"


def test_types():
    assert T.id_type(255, 256).str == "|u1" and T.id_type(256, 10).str == "<u2" and T.id_type(65536, 10).str == "<u4"


def test_shared_dir_has_a_scheme(spark):
    assert shared_dir(spark).startswith("file:///")
