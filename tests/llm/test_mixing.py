import numpy as np

from quillgraph.llm import mixing as M
from quillgraph.llm.common import table


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 50, 2000):
        p, t = rng.uniform(0, 1, n), rng.integers(0, 500, n)
        q = M.flight(p, t, np.random.default_rng(1))
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * t).sum() - (p * t).sum()) < 1e-3
        land = M.landing(q, np.random.default_rng(2))
        assert set(np.unique(land)) <= {0.0, 1.0} and abs(land.sum() - p.sum()) < 1 + 1e-6


def test_probabilities_are_kept():
    p, t = np.array([0.2, 0.5, 0.7, 0.35, 0.6]), np.array([5, 9, 2, 4, 4])
    draws = np.array([M.landing(M.flight(p, t, np.random.default_rng(s)), np.random.default_rng(10**6 + s)) for s in range(6000)])
    assert np.abs(draws.mean(axis=0) - p).max() < 0.03


def test_equal_sizes():
    q = M.flight(np.full(100, 0.3), np.full(100, 7), np.random.default_rng(4))
    assert ((q > 0) & (q < 1)).sum() <= 1 and abs(q.sum() - 30) < 1e-6


def filled(totals, weights=None, budget=M.BUDGET):
    """Inclusion probabilities by filling one source after another."""
    t = {k: float(v) for k, v in totals.items()}
    w = {k: weights.get(k, 0.0) if weights else max(v, 0.0) ** M.POWER for k, v in t.items()}
    out = {k: budget if t[k] <= 0 else 0.0 for k in t}
    goal = budget * sum(t.values())
    left = [k for k in t if t[k] > 0 and w[k] > 0]
    while left and goal > 1e-9:
        level = goal / sum(w[k] for k in left)
        full = [k for k in left if level * w[k] >= t[k]]
        for k in full or left:
            out[k] = min(1.0, level * w[k] / t[k])
        if not full:
            break
        goal -= sum(t[k] for k in full)
        left = [k for k in left if k not in full]
    return out


def shares(spark, totals, weights, budget):
    rows = [(k, float(v), 1, float(weights[k])) for k, v in totals.items()]
    return {r.mix_source: r.p for r in M.inclusion(spark.createDataFrame(rows, "mix_source string, t double, n long, w double"), budget).collect()}


def test_inclusion_fills_small_sources(spark):
    got = shares(spark, {"a": 1000, "b": 100, "c": 0}, {"a": 0.5, "b": 0.5, "c": 0.5}, 0.5)
    assert got["b"] == 1.0 and abs(got["a"] - 0.45) < 1e-9 and got["c"] == 0.5
    rng = np.random.default_rng(6)
    for budget in (0.05, 0.6, 0.95, 1.0):
        totals = {f"s{i}": int(x) for i, x in enumerate(rng.integers(0, 10000, 30))}
        weights = {k: float(x) for k, x in zip(totals, rng.integers(0, 5, 30), strict=True)}
        got, want = shares(spark, totals, weights, budget), filled(totals, weights, budget)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_drawn_totals(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    base = M.token_table(docs).toPandas()
    share = filled(base.groupby("mix_source")["tokens"].sum())
    got = M.drawn(docs).toPandas()
    assert got["doc_id"].is_unique
    for s, part in base.groupby("mix_source"):
        mine = got[got["source"] == s]
        assert abs(len(mine) - share[s] * len(part)) <= 2.001
        assert abs(mine["tokens"].sum() - share[s] * part["tokens"].sum()) <= 2 * part["tokens"].max()
    again = M.drawn(docs).toPandas()
    assert set(again["doc_id"]) == set(got["doc_id"])


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    base = M.token_table(docs).toPandas()
    share = filled(base.groupby("mix_source")["tokens"].sum())
    got = M.drawn(docs).toPandas()
    for s, part in base.groupby("mix_source"):
        assert abs(len(got[got["source"] == s]) - share[s] * len(part)) <= 2.001


def test_odd_rows(odd, none):
    got = M.mixed(odd)
    assert got.columns == odd.columns and 0 < got.count() <= odd.count()
    assert all(r.doc_id is not None for r in got.collect())
    assert M.mixed(none).count() == 0 and M.drawn(none).count() == 0
    assert {r.source for r in M.drawn(odd, budget=1.0).collect()} == {"a", "b", "c", None}
