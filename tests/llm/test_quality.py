import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import docstats, labelled, trees
from quillgraph.llm import quality_classifier as C
from quillgraph.llm import quality_rules as R
from quillgraph.llm import words as W
from quillgraph.llm.common import table


@pytest.fixture(scope="module")
def big(spark):
    sf = "/root/testdata/sf0.1"
    return table(spark, sf, "documents"), table(spark, sf, "labels")


@pytest.mark.parametrize("op", [C, R])
def test_held_out_accuracy(spark, big, op):
    docs, labels = big
    model = op.fit(docs, labels.where("doc_id % 2 = 0"))
    held = labels.where("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("z"))
    p = op.score(docs, model).join(held, "doc_id").toPandas()
    assert len(p) > 1000
    assert ((p["good"] >= 0.5) == (p["y"] == 1)).mean() > 0.97
    assert ((p["toxic"] > 0.5) == (p["z"] == 1)).mean() > 0.97
    clean = (p["y"] == 1) & (p["z"] == 0)
    assert p["keep"][clean].mean() > 0.97 and p["keep"][~clean].mean() < 0.08


def test_columns_equal_numpy(spark, big):
    docs, labels = big
    model = C.fit(docs, labels, 2000)
    small = table(spark, "/root/testdata/sf0.001", "documents")
    rows = small.orderBy("doc_id").collect()
    x = docstats.statistics(pa.array([r.text for r in rows], pa.large_string()), model.lexicon)
    got = C.score(small, model).orderBy("doc_id").toPandas()
    assert np.allclose(got["good"], model.good.probability(x), atol=2e-6)
    assert np.allclose(got["toxic"], model.toxic.probability(x), atol=2e-6)
    kept = C.accepted(small, model)
    assert kept.columns == small.columns and {r.doc_id for r in kept.collect()} == set(got[got["keep"]]["doc_id"])


def test_many_rules_make_no_method_beyond_what_compiles(spark):
    rng = np.random.default_rng(4)
    rules = [tuple((int(k), bool(rng.random() < 0.5), float(rng.random())) for k in rng.choice(len(docstats.NAMES), 3, replace=False)) for _ in range(400)]
    model = C.Classifier(C.Rules(0.1, rules, rng.normal(size=400)), C.Rules(-0.2, rules, rng.normal(size=400)), np.zeros(0, np.uint64))
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    for df in (C.score(docs, model), C.accepted(docs, model)):
        found = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
        sizes = [found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())]
        assert all(0 <= n < 2**16 for n in sizes)  # -1 where it doesn't compile
    got = C.score(docs, model).toPandas().sort_values("doc_id")
    rows = docs.orderBy("doc_id").collect()
    x = docstats.statistics(pa.array([r.text for r in rows], pa.large_string()), model.lexicon)
    assert np.allclose(got["good"], model.good.probability(x), atol=2e-6) and np.allclose(got["toxic"], model.toxic.probability(x), atol=2e-6)


def test_monotone_signs():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (3000, 3))
    y = (rng.random(3000) < 1 / (1 + np.exp(6 * np.sin(5 * x[:, 0]) - 3 * x[:, 1]))).astype(float)
    forest = trees.fit(x, y, monotone={0: -1, 1: 1})
    base = rng.uniform(0, 1, (200, 3))
    for k, sign in ((0, -1), (1, 1)):
        path = []
        for v in np.linspace(0, 1, 40):
            z = base.copy()
            z[:, k] = v
            path.append(forest.margin(z))
        assert (sign * np.diff(np.array(path), axis=0) >= -1e-9).all()
    free = trees.fit(x, y)
    assert ((free.probability(x) > 0.5) == (y > 0.5)).mean() > 0.7


def test_scoring_equals_walking_each_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = trees.fit(x, y, trees=20, depth=3)

    def walk(row):
        total = forest.base
        for t in range(len(forest.feature)):
            node = 0
            while forest.left[t, node] != node:
                node = forest.left[t, node] if row[forest.feature[t, node]] <= forest.threshold[t, node] else forest.right[t, node]
            total += forest.value[t, node]
        return total

    assert np.allclose(forest.margin(x), [walk(r) for r in x])
    assert ((forest.probability(x) > 0.5) == (y > 0.5)).mean() > 0.95
    rules = trees.paths(forest)
    assert trees.holds(rules, x).shape == (500, len(rules)) and len(set(rules)) == len(rules)


def test_lasso_drops_rules():
    rng = np.random.default_rng(2)
    a = rng.random((2000, 30)) < 0.5
    y = (rng.random(2000) < 1 / (1 + np.exp(-(3.0 * a[:, 0] - 2.0 * a[:, 1] - 0.5)))).astype(float)
    _, w = trees.lasso_logistic(a, y, 0.02)
    assert w[0] > 0.8 and w[1] < -0.4 and (np.abs(w[2:]) < 1e-6).sum() >= 26


def test_statistics_by_hand():
    texts = ["", None, "A b, b b!\nx1\nx1", "!!"]
    x = docstats.statistics(pa.array(texts, pa.string()), np.sort(W.split(["b"]).hashes))
    s = dict(zip(docstats.NAMES, x[2], strict=True))
    assert np.isclose(s["log_words"], np.log1p(6)) and np.isclose(s["mean_word_bytes"], 8 / 6) and np.isclose(s["distinct_share"], 3 / 6)
    assert np.isclose(s["echo_share"], 3 / 6) and np.isclose(s["top_word_share"], 3 / 6) and np.isclose(s["repeat_line_share"], 1 / 3) and np.isclose(s["line_words"], 2)
    assert s["flagged_words"] == 3 and np.isclose(s["upper_share"], 1 / 6) and np.isclose(s["marks_per_word"], 2 / 6)
    assert (x[0] == 0).all() and (x[1] == 0).all() and x[3][docstats.NAMES.index("marks_per_word")] == 2


@pytest.mark.parametrize("op", [C, R])
def test_odd_rows(spark, odd, none, big, op):
    docs, labels = big
    model = op.fit(docs, labels, 1000)
    got = op.score(odd, model)
    assert got.count() == odd.count() and got.where("good is null or toxic is null or keep is null").count() == 0
    assert op.score(none, model).count() == 0
    nulls = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 1, None), (3, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert op.score(odd, op.fit(odd, nulls)).count() == odd.count()
    even = op.score(odd, op.fit(odd, labels.limit(0)))
    assert even.where("keep").count() == odd.count()
    assert op.score(none, op.fit(none, labels)).count() == 0


def test_sample_is_bounded(spark, big):
    docs, labels = big
    x, y, z, lexicon = labelled.training(docs, labels, 50)
    assert 0 < len(x) <= 50 and len(x) == len(y) == len(z) and len(lexicon) <= labelled.LEXICON_WORDS
