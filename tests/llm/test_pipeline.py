import json

import pytest

import corpus_pipeline as P
from quillgraph.llm import decontaminate, quality_classifier, simhash, token_output
from quillgraph.llm.common import stored, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """What goes into each stage, and what comes out of the last."""
    docs = [table(spark, SF, "documents")]
    for name, stage in P.STAGES:
        docs.append(stored(stage(spark, docs[-1], SF), "test-" + name.replace(" ", "-")))
    return docs


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_order_and_columns(steps):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources", "token output"]
    for before, after in zip(steps[:-2], steps[1:-1], strict=True):
        assert after.columns == before.columns
        a, b = ids(after), ids(before)
        assert len(a) == len(set(a)) and set(a) <= set(b)


def test_each_stage_against_its_input(spark, steps):
    labels = table(spark, SF, "labels")
    scored = quality_classifier.score(steps[0], quality_classifier.fit(steps[0], labels)).toPandas()
    assert set(ids(steps[1])) == set(scored[scored["keep"]]["doc_id"])
    groups = simhash.groups(steps[1])[0].toPandas()
    assert set(ids(steps[2])) == set(ids(steps[1])) - set(groups[~groups["keep"]]["doc_id"])
    assert set(groups[groups["keep"]]["doc_id"]) <= set(ids(steps[2]))
    hit = {r.doc_id for r in decontaminate.contaminated(steps[2], table(spark, SF, "benchmark")).collect()}
    assert hit and set(ids(steps[3])) == set(ids(steps[2])) - hit
    assert 0.75 < steps[4].count() / steps[3].count() <= 1
    assert sorted(ids(steps[5])) == sorted(ids(steps[4]))


def test_no_near_copies_are_left(spark, steps):
    p = simhash.fingerprint_table(steps[2]).toPandas()
    f0, f1 = p["f0"].to_numpy().view("u8"), p["f1"].to_numpy().view("u8")
    d = simhash.hamming(f0[:, None], f1[:, None], f0[None], f1[None])
    assert (d <= simhash.FAR).sum() == len(p) > 300  # each only with itself
    # two documents that are near, without three equal bytes in a half of their fingerprints
    two = steps[0].where("doc_id in (61, 777)")
    assert ids(P.drop_near_copies(spark, two, SF)) == [61]


def test_labels_and_planted_passages(spark, steps):
    labels = {r.doc_id: (r.quality, r.toxic) for r in table(spark, SF, "labels").collect()}
    kept, known = set(ids(steps[1])), set(labels)
    clean = {d for d in known if labels[d] == (1, 0)}
    assert len(clean & kept) >= 0.97 * len(clean) and len((known - clean) & kept) <= 0.1 * len(known - clean)
    items = [" ".join(r.text.lower().split()) for r in table(spark, SF, "benchmark").collect()]
    assert not any(i in " ".join(r.text.lower().split()) for r in steps[3].collect() for i in items)


def test_tokens_decode_to_the_texts(spark, steps):
    rows = steps[5].collect()
    folder = rows[0].file.rpartition("/")[0]
    corpus = token_output.Corpus(folder)
    enc, text = token_output.encoder(token_output.VOCABULARY), {r.doc_id: r.text for r in steps[4].collect()}
    order = sorted(rows, key=lambda r: (r.shard, r.position))
    assert [enc.decode(corpus[n][:-1].tolist()) for n in range(len(corpus))] == [text[r.doc_id] for r in order]
    assert json.load(open(folder.removeprefix("file://") + "/manifest.json"))["dtype"] == "<u2"


def test_run_gives_the_same(spark, steps):
    assert sorted(ids(P.run(spark, SF))) == sorted(ids(steps[5]))


def test_odd_rows(spark, odd, none, tmp_path):
    for t in ("labels", "benchmark"):
        table(spark, SF, t).write.parquet(f"{tmp_path}/{t}.parquet")
    left = {}
    for df in (odd, none):
        for name, stage in P.STAGES:
            before = df
            df = stored(stage(spark, df, str(tmp_path)), "odd")
            if name != "token output":
                assert df.columns == odd.columns
            left.setdefault(name, []).append(sorted((-1 if r.doc_id is None else r.doc_id) for r in df.select("doc_id").collect()))
        assert sorted(ids(df), key=lambda x: x or -1) == sorted(ids(before), key=lambda x: x or -1)
    first, near, clean, mixed, tokens = (left[n][0] for n, _ in P.STAGES)
    scored = quality_classifier.score(odd, quality_classifier.fit(odd, table(spark, str(tmp_path), "labels"))).collect()
    assert first == sorted((-1 if r.doc_id is None else r.doc_id) for r in scored if r.keep)
    # of near copies the smallest id, of several rows of an id one; rows without an id stay until they are mixed
    assert set(near) == set(first) - ({2} if {1, 2} <= set(first) else set()) - ({6} if {5, 6} <= set(first) else set()) and near.count(-1) == first.count(-1)
    assert all(near.count(x) == 1 for x in near if x != -1)
    assert clean == near and -1 not in mixed and set(mixed) <= set(clean) and tokens == mixed
    assert all(x[1] == [] for x in left.values())
