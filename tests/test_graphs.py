import math

import pytest

from quillgraph.operators import graphs, relational


def make(spark, edges, extra=()):
    names = sorted({x for e in edges for x in e[:2]} | set(extra))
    ids = {n: k + 1 for k, n in enumerate(names)}
    nodes = spark.createDataFrame([(i, n, "function", n, None) for n, i in ids.items()], "id long, uid string, type string, name string, attrs string")
    rows = [(ids[e[0]], ids[e[1]], e[2] if len(e) > 2 else "CALLS", 1.0, float(e[3]) if len(e) > 3 else 1.0) for e in edges]
    return nodes, spark.createDataFrame(rows, "src long, dst long, relation string, weight double, confidence double"), ids


@pytest.fixture(scope="module")
def chain(spark):
    return make(spark, [("a", "b"), ("b", "c"), ("c", "d", "WRITES")])


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def test_directions_and_depths(spark, chain):
    n, e, ids = chain
    reach = lambda d, k, **kw: {r.id: r.depth for r in graphs.traverse(n, e, seeds(spark, ids["b"], 999), k, direction=d, **kw).collect()}
    assert reach("out", 1) == {2: 0, 3: 1} and reach("in", 1) == {2: 0, 1: 1} and reach("both", 1) == {1: 1, 2: 0, 3: 1}
    assert reach("out", 5) == {2: 0, 3: 1, 4: 2} and reach("out", 0) == {2: 0}
    assert reach("out", 5, relations=["CALLS"]) == {2: 0, 3: 1} and reach("out", 5, relations=[]) == reach("out", 5)
    with pytest.raises(ValueError):
        reach("up", 1)


def test_cycles_end(spark):
    n, e, ids = make(spark, [("a", "b"), ("b", "a"), ("a", "a")])
    assert {r.id: r.depth for r in graphs.traverse(n, e, seeds(spark, 1), 50).collect()} == {1: 0, 2: 1}


def test_degree(spark):
    n, e, ids = make(spark, [("a", "b"), ("a", "b", "USES"), ("b", "a"), ("c", "c")], extra=["lone"])
    got = {r.id: r.degree for r in graphs.degree(n, e).collect()}
    assert got == {ids["a"]: 2 / 3, ids["b"]: 2 / 3, ids["c"]: 2 / 3, ids["lone"]: 0.0}
    one, none, _ = make(spark, [("a", "a")])
    assert graphs.degree(one, none).first().degree == 1.0


def test_pagerank(spark):
    n, e, ids = make(spark, [*((f"c{k}", "hub") for k in range(4)), ("hub", "queue", "CALLS", 0.9), ("hub", "log", "WRITES", 0.8)])
    got = {r.id: r.rank for r in graphs.pagerank(n, e).collect()}
    assert math.isclose(sum(got.values()), 1.0) and got[ids["hub"]] == max(got.values()) and got[ids["queue"]] > got[ids["log"]] > got[ids["c0"]]
    # by hand
    out, names = {}, sorted(got)
    for s, d, c in [(ids[f"c{k}"], ids["hub"], 1.0) for k in range(4)] + [(ids["hub"], ids["queue"], 0.9), (ids["hub"], ids["log"], 0.8)]:
        out.setdefault(s, {})[d] = c
    r = {x: 1 / len(names) for x in names}
    for _ in range(100):
        loose = sum(r[x] for x in names if x not in out)
        new = {x: 0.15 / len(names) + 0.85 * loose / len(names) for x in names}
        for s, to in out.items():
            for d, c in to.items():
                new[d] += 0.85 * r[s] * c / sum(to.values())
        done = sum(abs(new[x] - r[x]) for x in names) < len(names) * 1e-6
        r = new
        if done:
            break
    assert all(math.isclose(got[x], r[x], abs_tol=1e-9) for x in names)
    assert graphs.pagerank(n.limit(0), e).count() == 0


def test_betweenness_and_closeness(spark):
    n, e, ids = make(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "c")])
    b = {r.id: r.value for r in graphs.centrality(n, e, "betweenness").collect()}
    assert math.isclose(b[ids["c"]], 3 / 12) and math.isclose(b[ids["b"]], 1 / 12) and b[ids["a"]] == 0
    c = {r.id: r.value for r in graphs.centrality(n, e, "closeness").collect()}
    assert c[ids["a"]] == 0 and math.isclose(c[ids["b"]], 1 / 4) and math.isclose(c[ids["c"]], 3 / 4 * 3 / 4) and math.isclose(c[ids["d"]], 4 / 8)
    with pytest.raises(ValueError):
        graphs.centrality(n, e, "eigen")


def test_ceilings(spark, chain, monkeypatch):
    n, e, _ = chain
    with pytest.raises(ValueError):
        graphs.bounded(n, e, nodes_most=2)


def test_paths(spark, chain):
    n, e, ids = chain
    assert graphs.shortest_path(n, e, 1, 4) == [1, 2, 3, 4]
    assert graphs.shortest_path(n, e, 1, 4, max_depth=2) is None and graphs.shortest_path(n, e, 4, 1) is None
    assert graphs.shortest_path(n, e, 4, 1, direction="both") == [4, 3, 2, 1]
    assert graphs.shortest_path(n, e, 2, 2) == [2] and graphs.shortest_path(n, e, 99, 99) is None
    n, e, ids = make(spark, [("a", "m"), ("a", "k"), ("m", "z"), ("k", "z")])
    assert graphs.shortest_path(n, e, ids["a"], ids["z"]) == [ids["a"], ids["k"], ids["z"]]


def test_communities(spark):
    tri = lambda p: [(f"{p}1", f"{p}2"), (f"{p}2", f"{p}3"), (f"{p}3", f"{p}1")]
    n, e, ids = make(spark, [*tri("a"), *tri("b"), ("a1", "b1", "CALLS", 0.2)], extra=["z"])
    assert graphs.communities(n, e) == [[1, 2, 3], [4, 5, 6], [7]]


def test_centrality_scores(spark, chain):
    n, e, ids = chain
    assert graphs.centrality_scores(n, e, seeds(spark, 2), 1, prefer="DEGREE").count() == 3
    assert graphs.centrality_scores(n, e, seeds(spark, 2), 1).count() == 3
    with pytest.raises(ValueError):
        graphs.centrality_scores(n, e, seeds(spark, 2), 1, prefer="luck")


def test_strongest_takes_the_first_relation_of_ties(spark):
    n, e, _ = make(spark, [("a", "b", "USES", 0.5), ("a", "b", "CALLS", 0.9), ("a", "b", "BUILDS", 0.9)])
    r = relational.strongest(e).collect()
    assert [(x.confidence, x.relation) for x in r] == [(0.9, "BUILDS")]
    assert relational.symbol_exists(n, "a") and not relational.symbol_exists(n, "q")


def beyond(*_):
    raise ValueError("beyond the ceilings")


def odd(spark):
    """Two parts with loops, parallel and opposite edges, ties, a node alone, and edges that leave the nodes."""
    pairs = [(1, 2), (2, 3), (3, 4), (1, 5), (5, 3), (4, 1), (6, 6), (7, 8), (8, 7), (7, 9), (2, 3), (4, 99), (98, 1)] + [(1, x) for x in range(20, 32)]
    ids = spark.createDataFrame([(x,) for x in [*range(1, 11), *range(20, 32), 5]], "id long")
    return ids, spark.createDataFrame([(a, b, f"R{k % 3}", 1.0, [1.0, 0.3, 0.7][k % 3]) for k, (a, b) in enumerate(pairs)], "src long, dst long, relation string, weight double, confidence double")


@pytest.mark.parametrize("kind", ["betweenness", "closeness"])
def test_centrality_beyond_the_ceilings(spark, monkeypatch, kind):
    n, e = odd(spark)
    want = {r.id: r.value for r in graphs.centrality(n, e, kind).collect()}
    monkeypatch.setattr(graphs, "bounded", beyond)
    got = {r.id: r.value for r in graphs.centrality(n, e, kind).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], abs_tol=1e-12) for x in want) and max(want.values()) > 0


def test_centrality_of_more_nodes_than_the_ceiling(spark):
    ids = spark.range(graphs.CEILING_NODES + 100)
    star = ids.where("id > 0").selectExpr("id as src", "0L as dst", "'R' as relation", "1.0D as weight", "1.0D as confidence")
    got = {r.id: r.value for r in graphs.centrality(ids, star, "closeness").collect()}
    assert len(got) == graphs.CEILING_NODES + 100 and got[0] == 1.0 and got[1] == 0.0


def test_communities_beyond_the_ceilings(spark, monkeypatch):
    n, e = odd(spark)
    want = graphs.communities(n, e)
    monkeypatch.setattr(graphs, "bounded", beyond)
    assert graphs.communities(n, e) == want and len(want) > 4 and sum(map(len, want)) == 22
    assert graphs.communities(n, e.limit(0)) == [[x] for x in [*range(1, 11), *range(20, 32)]]


def test_greedy_modularity_of_a_hub(spark):
    """A hub's neighbours join one after another without a look at all the others each time."""
    e = [(0, x, 1.0) for x in range(1, 20_000)] + [(20_000, x, 1.0) for x in range(20_001, 40_000)] + [(0, 20_000, 1.0)]
    got = graphs.greedy_modularity(list(range(40_000)), e, graphs._total([1.0] * len(e)))
    assert got == [list(range(20_000)), list(range(20_000, 40_000))]


def test_pagerank_shuffles_no_links_in_a_round(spark, tmp_path):
    from quillgraph.session import bucketed

    links = bucketed(spark.range(100).selectExpr("id as src", "id + 1 as dst"), "src", 8)
    plan = links.join(spark.range(10).withColumnRenamed("id", "src").hint("merge"), "src")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(src") == 1


def test_shortest_path_against_brute_force(spark):
    import itertools
    import random

    r = random.Random(3)
    pairs = sorted({(r.randrange(1, 15), r.randrange(1, 15)) for _ in range(26)})
    n, e = spark.range(1, 16), spark.createDataFrame([(a, b, "R", 1.0, 1.0) for a, b in pairs], "src long, dst long, relation string, weight double, confidence double")
    lens, known = [], set(pairs)
    for a, b in [(1, 9), (2, 14), (5, 3), (7, 15), (11, 4)]:
        some = [(a, *mid, b) for k in range(4) for mid in itertools.product(range(1, 15), repeat=k) if all(x in known for x in itertools.pairwise((a, *mid, b)))]
        want = min(some, key=lambda p: (len(p), p)) if some else None
        got = graphs.shortest_path(n, e, a, b, 4)
        assert (tuple(got) if got else None) == want
        lens.append(len(got or []))
    assert max(lens) >= 3 and min(lens) == 0
