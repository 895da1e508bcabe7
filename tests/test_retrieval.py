import math
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import filters, merges, metrics, ranking, vectors
from quillgraph.plans import packing, retrieval
from quillgraph.sources import graph as G
from quillgraph.sources.query_cache import QueryCache

NAMES = {"MassNotificationJob": "send every notification to users", "send_notification": "push one notification through a queue", "RedisQueue": "queue in redis", "PushProvider": "deliver push message", "NotificationLog": "write log of messages"}
EDGES = [("MassNotificationJob", "send_notification", "CALLS", 1.0), ("send_notification", "RedisQueue", "CALLS", 0.9), ("send_notification", "PushProvider", "CALLS", 0.8), ("send_notification", "NotificationLog", "WRITES", 0.7)]
NOW = 1_700_000_000.0


@pytest.fixture(scope="module")
def graph(spark):
    ids = {n: k + 1 for k, n in enumerate(NAMES)}
    rows = [(i, n, "function", n, b, '{"lang": "python", "file_uid": "src/f.py"}', False) for (n, b), i in zip(NAMES.items(), ids.values(), strict=True)]
    rows += [(90, "src/f.py", "file", "f.py", None, '{"mtime": %f}' % (NOW - 30 * 86400), False), (91, "odd.py", "file", "odd.py", None, '{"mtime": "soon"}', False), (92, "odd", "class", "odd", None, '{"lang": "go", "file_uid": "odd.py"}', False)]
    nodes = spark.createDataFrame(rows, "id long, uid string, type string, name string, body string, attrs string, embed_dirty boolean")
    edges = spark.createDataFrame([(ids[a], ids[b], r, 1.0, c, None) for a, b, r, c in EDGES], "src long, dst long, relation string, weight double, confidence double, source string")
    text = nodes.where("type = 'function'").withColumn("v", T.hashing_embedding(F.concat_ws(" ", "name", "body"), 64))
    emb = text.select(F.col("id").alias("node_id"), F.size("v").alias("dim"), F.col("v").alias("vector"), F.lit("h").alias("model"))
    return G.Graph(nodes.cache(), edges.cache(), emb.cache())


@pytest.fixture(scope="module")
def planner(spark, graph):
    def embed(q):
        return [float(x) for x in spark.range(1).select(T.hashing_embedding(F.lit(q), 64).alias("v")).first().v]

    return retrieval.Planner(graph, embed, now=NOW)


def test_locate(planner):
    got = planner.retrieve("where is `RedisQueue` used?")
    assert got["symbol"] == "RedisQueue" and [r["src_uid"] for r in got["references"]] == ["send_notification"] and not got["ambiguous"]
    assert planner.retrieve("who calls nothing_here")["references"] == []


def test_explain_ranks_and_packs(planner):
    got = planner.retrieve("how does send_notification work?", k=2, depth=1)
    assert got["intent"] == "EXPLAIN" and got["ranking"] and got["seeds"]
    first = {n["id"]: n["uid"] for n in got["nodes"]}[got["ranking"][0]]
    assert first == "send_notification"
    for budget in (0, 5, 30, 80, 400, 4000):
        p = packing.pack(got, budget)
        assert p.used_tokens <= budget and p.dropped + len(p.uids) == len(got["nodes"])
    assert "**Relationships**" in packing.pack(got, 4000).text


def test_scores_add_up(spark, graph, planner):
    ids = graph.nodes.where("type = 'function'").select("id")
    q = planner.embed("send notification")
    rows = ranking.hybrid(graph.nodes, graph.edges, graph.embeddings, ids, q, 1, now=NOW).collect()
    for r in rows:
        assert math.isclose(r.score, r.vector + r.centrality + r.confidence + r.recency)
        assert math.isclose(r.recency, 0.15 * math.exp(-1), rel_tol=1e-6)
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
    one = ranking.hybrid(graph.nodes, graph.edges.limit(0), graph.embeddings.limit(0), ids.where("id = 1"), q, 0, now=NOW).first()
    assert math.isclose(one.centrality, 0.25 * 0.5) and one.vector == 0 and one.confidence == 0
    lost = ranking.hybrid(graph.nodes, graph.edges, graph.embeddings, graph.nodes.where("uid = 'odd'").select("id"), q, 0, now=NOW).first()
    assert math.isclose(lost.recency, 0.15 * 0.5)


def test_weights():
    assert ranking.Weights(2, 1, 1, 1).shares()["vector"] == 0.4
    for bad in (ranking.Weights(0, 0, 0, 0), ranking.Weights(-1, 2, 0, 0)):
        with pytest.raises(ValueError):
            bad.shares()


def test_top_k_ties_types_and_dimensions(spark):
    rows = [("c::z", [1.0, 0.0], "t"), ("a::x", [1.0, 0.0], "t"), ("b::y", [1.0, 0.0], "u"), ("d", [0.0, 1.0], "t"), ("e", [1.0, 0.0, 0.0], "t")]
    v = spark.createDataFrame(rows, "uid string, vector array<float>, type string").withColumn("dim", F.size("vector"))
    got = lambda k, types=None: [r.uid for r in vectors.top_k(v, [(0, [1.0, 0.0])], k, types).orderBy("rank").collect()]
    assert got(3) == ["a::x", "b::y", "c::z"] and got(0) == [] and got(-2) == [] and got(9) == ["a::x", "b::y", "c::z", "d"]
    assert got(9, ["u"]) == ["b::y"] and got(9, []) == got(9)


def test_filters(graph):
    uids = lambda f, k=0: [r.uid for r in filters.filtered(graph.nodes, f, k)[0].collect()]
    assert uids({"lang": "go"}) == ["odd"] and uids({"type": "class", "lang": "python"}) == []
    assert len(uids({"path_glob": "src/*"})) == 5 and uids({"path_glob": "SRC/*"}) == [] and uids({"path_glob": "odd.p[xy]"}) == ["odd"] and uids({"path_glob": "odd.p[^y]"}) == []
    assert len(uids({"since": NOW - 31 * 86400})) == 5 and uids({"since": NOW}) == []
    assert len(uids({"lang": "python"}, 2)) == 3
    assert filters.filtered(graph.nodes, {"color": 1, "lang": ["x"], "since": "2026"}) == (None, ["color", "lang", "since"])
    assert uids({"lang": "x' OR 1=1 --"}) == []


def test_epochs():
    e = filters.to_epoch
    assert e("1970-01-02") == 86400 and e("19700102") == 86400 and e("1970-01-01T01:00Z") == 3600 and e("1970-01-01 00:00:05+00:00") == 5 and e(7) == 7.0
    for bad in (None, True, "2026", "soon", float("nan"), 10**400, "", "1970-01-01 00:00:00.5"):
        assert e(bad) is None


def test_filter_plan_is_capped(planner):
    got = planner.filter({"lang": "python"}, 2)
    assert len(got["nodes"]) == 2 and got["truncated"]
    assert got["matched_ids"] == [n["id"] for n in got["nodes"]] and got["dropped_keys"] == []
    lost = planner.filter({"x": 1})
    assert lost["note"] and lost["dropped_keys"] == ["x"]


def test_filter_never_raises(planner, monkeypatch):
    def fails(*_):
        raise ValueError("no such table")

    monkeypatch.setattr(filters, "filtered", fails)
    got = planner.filter({"lang": "python"})
    assert got["nodes"] == [] and got["matched_ids"] == [] and got["note"]


def test_unknown_symbols(graph):
    class Fixed:
        def __init__(self, symbol):
            self.symbol = symbol

        def analyze(self, query):
            return retrieval.Intent("LOCATE", self.symbol)

    class Plain:
        def classify(self, query):
            return "locate"

    new = lambda router: retrieval.Planner(graph, lambda q: [0.0] * 64, router)
    assert new(Fixed("gone")).verdict("x").intent == "EXPLAIN" and new(Fixed("odd")).verdict("x").symbol == "odd"
    assert new(Plain()).verdict("x") == retrieval.Intent("LOCATE")
    # a symbol that names nothing is followed by the query's own words
    assert new(None).locate("who uses RedisQueue", "gone")["symbol"] == "RedisQueue"


def test_candidates():
    assert retrieval.candidates("where is a.py::getUser and get used by cache") == ["a.py::getUser", "getUser", "cache", "used", "get"]
    assert retrieval.classify("Which jobs CALL it") == "LOCATE" and retrieval.classify("hello") == "EXPLAIN"


def test_model_router():
    replies = {"a": 'so: ```json\n{"intent": "locate", "symbol": "x", "confidence": 0.9}\n```', "b": "no json", "c": '{"intent": "LOCATE", "symbol": "gone", "confidence": 0.9}', "d": '{"intent": "FILTER", "filters": {"lang": "go"}, "confidence": 0.4}', "e": '{"intent": "FILTER", "filters": {"lang": "go"}}', "f": '{"intent": "LOCATE", "confidence": 7}'}
    asked = []
    r = retrieval.ModelRouter(lambda s, u: (asked.append(u), replies[u])[1], exists=lambda s: s == "x", cache=3)
    assert r.analyze("a").symbol == "x" and r.analyze("b").intent == "EXPLAIN" and r.analyze("c").intent == "EXPLAIN" and r.analyze("d").intent == "EXPLAIN"
    got = r.analyze("e")
    got.filters["lang"] = "changed"
    assert r.analyze("e").filters == {"lang": "go"} and asked.count("e") == 1 and r.analyze("f").intent == "EXPLAIN"
    assert retrieval.ModelRouter(lambda s, u: 1 / 0).analyze("who uses it").intent == "LOCATE"
    known: set[str] = set()
    late = retrieval.ModelRouter(lambda s, u: '{"intent": "LOCATE", "symbol": "new"}', exists=known.__contains__)
    assert late.analyze("q").intent == "EXPLAIN"
    known.add("new")
    assert late.analyze("q").symbol == "new"


def test_safe_text():
    assert packing.safe("# x\n`y`") == "\\# x y" and packing.safe("__init__") == "__init__" and packing.safe("___") == "\\___" and packing.safe("") == "" and packing.safe("[a]: b") == "\\[a]: b" and packing.safe("_ _ _") == "\\_ _ _"
    assert packing.clip("a" * 300).endswith("…") and packing.cost("") == 1 and packing.cost("abcde") == 2 and packing.tail("a.py::b.c") == "b.c"


def test_greedy_packing_skips_what_does_not_fit():
    nodes = [{"id": k, "uid": f"u{k}", "name": f"n{k}", "type": "f", "attrs": {"docstring": "x" * n}} for k, n in enumerate((50, 230, 10))]
    got = packing.pack({"intent": "EXPLAIN", "nodes": nodes, "ranking": [0, 1, 2], "edges": []}, 60)
    assert got.uids == ["u0", "u2"] and got.dropped == 1 and got.truncated
    refs = [{"src_name": "a" * 60, "src_uid": "f::a", "relation": "CALLS", "confidence": 1.0}, {"src_name": "b", "src_uid": "f::b", "relation": "CALLS", "confidence": 1.0}]
    got = packing.pack({"intent": "LOCATE", "symbol": "s", "references": refs}, 20)
    assert got.uids == ["f::b"] and got.dropped == 1 and got.used_tokens <= 20
    assert "(no references)" in packing.pack({"intent": "LOCATE", "symbol": "s", "references": []}, 50).text


def test_edge_upserts(spark, graph):
    up = lambda *rows: spark.createDataFrame(rows, "src_uid string, dst_uid string, relation string, weight double, confidence double, source string, seq long")
    batch = up(("RedisQueue", "PushProvider", "CALLS", 1.0, 0.6, "a", 0), ("RedisQueue", "PushProvider", "CALLS", 2.0, 0.97, "b", 1), ("RedisQueue", "PushProvider", "CALLS", 3.0, 0.97, "c", 2), ("RedisQueue", "PushProvider", "CALLS", 4.0, 0.1, "d", 3), ("RedisQueue", "none", "CALLS", 4.0, 0.1, "d", 4))
    merged, missing = merges.upsert_edges(graph.edges, batch, graph.nodes)
    r = merged.where("src = 3 and dst = 4").first()
    assert (r.weight, r.confidence, r.source) == (2.0, 0.97, "b") and missing.count() == 1 and merged.count() == 5
    again, _ = merges.upsert_edges(merged, up(("RedisQueue", "PushProvider", "CALLS", 9.0, 0.97, "z", 0)), graph.nodes)
    assert again.where("src = 3 and dst = 4").first().weight == 2.0
    dirty = merges.dirty_ends(graph.nodes, merged.where("src = 3"))
    assert {x.uid for x in dirty.where("embed_dirty").collect()} == {"RedisQueue", "PushProvider"}


def test_embeddings_are_unit(spark, graph):
    new = spark.createDataFrame([(1, [3.0, 4.0], "m"), (2, [0.0, 0.0], "m"), (777, [1.0, 0.0], "m")], "node_id long, vector array<double>, model string")
    emb, nodes = merges.set_embeddings(graph.embeddings, new, graph.nodes.withColumn("embed_dirty", F.lit(True)))
    got = {r.node_id: list(r.vector) for r in emb.collect()}
    assert [round(x, 6) for x in got[1]] == [0.6, 0.8] and got[2] == [0.0, 0.0] and 777 not in got
    assert {r.id for r in nodes.where("not embed_dirty").collect()} == {1, 2}


def test_pending(spark, graph):
    rows = spark.createDataFrame([("s", "f", "RedisQueue", "CALLS", 0.3, None, None), ("s", "f", "gone", "CALLS", 0.97, "x.py::RedisQueue", None), ("s", "f", "odd", "USES", 0.9, "odd", None), ("s", "f", "f.py", "CALLS", 0.3, None, None)], G.PENDING)
    got = {r.dst_name: r.to_uid for r in merges.resolve_pending(rows, graph.nodes).collect()}
    assert got == {"RedisQueue": "RedisQueue", "gone": None, "odd": "odd", "f.py": None}


def test_metrics(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id int")
    ret = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "a", 2), (1, "c", 3), (3, "x", 0)], "case_id int, uid string, pos int")
    exp = spark.createDataFrame([(1, "a", 1.0), (1, "c", 1.0), (1, "d", 1.0), (2, "q", 1.0)], "case_id int, uid string, gain double")
    s = {r.case_id: r for r in metrics.set_metrics(cases, ret, exp).collect()}
    assert math.isclose(s[1].precision, 2 / 3) and math.isclose(s[1].f1, 2 / 3) and s[2].precision == 0 and s[3].recall == 1
    r = {r.case_id: r for r in metrics.rank_metrics(cases, ret, exp, 2).collect()}
    assert math.isclose(r[1].recall_at_k, 1 / 3) and r[1].mrr == 1.0
    n = {r.case_id: r for r in metrics.rank_metrics(cases, ret, exp, 3).collect()}
    assert math.isclose(n[1].ndcg, 1.5 / (1 + 1 / math.log2(3) + 0.5))
    assert metrics.averages(metrics.set_metrics(cases, ret, exp)).first().n == 3


def test_query_cache(tmp_path):
    c = QueryCache("m", 2, most=2)
    for k, q in enumerate(("a", "b", "c")):
        c.put(q, [k, 1.0])
    assert len(c) == 2 and c.get("a") is None and c.get("c") == [2.0, 1.0]
    at = str(tmp_path / "cache")
    assert c.dump(at) == 2
    d = QueryCache("m", 2)
    assert d.load(at) == 2 and d.get("b") == [1.0, 1.0]
    assert QueryCache("other", 2).load(at) == 0 and QueryCache("m", 3).load(at) == 0 and QueryCache("m", 2).load(at + "x") == 0
    data = bytearray(open(at, "rb").read())
    for bad in (data[:-1], data[:9], b"", data[:-1] + bytes([data[-1] ^ 1])):
        open(at, "wb").write(bad)
        assert QueryCache("m", 2).load(at) == 0
    d.reconcile("n", 2)
    assert len(d) == 0


def test_hashing_embedding(spark):
    import hashlib
    import re

    def plain(text, dim):
        toks = []
        for w in re.findall(T.IDENTIFIER, text):
            toks.append(w.lower())
            toks += [p.lower() for p in re.findall(T.PART, w) if p.lower() != w.lower()]
        v = [0.0] * dim
        for t in toks:
            v[int(hashlib.md5(t.encode()).hexdigest(), 16) % dim] += 1
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        return toks, [x / n for x in v]

    texts = ["send_notification MassNotificationJob HTTPServer2 été x1", "", "___", "A a", "snake_case_Name"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for dim in (64, 100):
        for r in df.select("t", T.subtokens(F.col("t")).alias("s"), T.hashing_embedding(F.col("t"), dim).alias("v")).collect():
            toks, v = plain(r.t, dim)
            assert r.s == toks and max(abs(a - b) for a, b in zip(v, r.v, strict=True)) < 1e-6
    assert spark.range(1).select(T.token_cost(F.lit("")), T.token_cost(F.lit("abcde")), T.clip(F.lit("a\nb"), 5)).first()[:] == (1, 2, "a b")


def test_top_k_of_every_row_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    m = rng.integers(-2, 3, (90, 4)).astype(np.float32)  # many ties
    rows = [(i, [float(x) for x in v], "ab"[i % 2], 4) for i, v in enumerate(m)] + [(200, [1.0, 0.0], "a", 2), (201, [0.5, 0.0], "b", 2), (202, None, "a", -1)]
    df = spark.createDataFrame(rows, "node_id long, vector array<float>, type string, dim int")
    for block in (1000, 17):
        for k, types in ((5, None), (3, ["b"]), (500, ["a"]), (0, None)):
            got = {(r.query_id, r["rank"]): r.node_id for r in vectors.top_k_all(df, k, types, block=block).collect()}
            want = {}
            for q, v, _, d in rows:
                near = sorted((-float(np.dot(v, w)), i) for i, w, t, e in rows if d == e and v and (not types or t in types))
                want |= {(q, n + 1): i for n, (_, i) in enumerate(near[:k])}
            assert got == want


def test_all_embeddings_are_queries(spark, sf):
    from quillgraph.plans import queries as Q

    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    for name in ("vector_topk", "vector_topk_types"):
        got = Q.queries()[name](spark, sf).select("query_id").collect()
        assert {r.query_id for r in got} == ids and len(got) == 10 * len(ids)


def test_hybrid_over_whole_tables_against_brute_force(spark, sf):
    import json

    import numpy as np

    from quillgraph.plans import queries as Q
    from quillgraph.sources import graph as G

    g = G.from_tables(spark, sf)
    nodes, edges = g.nodes.collect(), g.edges.collect()
    at = {r.id: i for i, r in enumerate(nodes)}
    n = len(nodes)
    links, sums, count = {}, np.zeros(n), np.zeros(n)
    for e in edges:
        a, b = at[e.src], at[e.dst]
        links[a, b] = max(links.get((a, b), 0.0), e.confidence)
        for x in {a, b}:
            sums[x] += e.confidence
            count[x] += 1
    m = np.zeros((n, n))
    for (a, b), c in links.items():
        m[b, a] = c
    total = m.sum(axis=0)
    m /= np.where(total > 0, total, 1)
    rank = np.full(n, 1 / n)
    for _ in range(100):
        new = 0.15 / n + 0.85 * rank[total == 0].sum() / n + 0.85 * (m @ rank)
        change, rank = np.abs(new - rank).sum(), new
        if change < n * 1e-6:
            break
    rank /= rank.sum()
    vec = {G.KINDS["order"] * G.STEP + r.node_id: np.array(r.vector, float) for r in g.embeddings.collect()}
    query = vec[G.KINDS["order"] * G.STEP]
    attrs = [json.loads(r.attrs or "{}") for r in nodes]
    files = {r.uid: a["mtime"] for r, a in zip(nodes, attrs, strict=True) if r.type == "file"}
    now = max(files.values())
    want = {}
    for i, (r, a) in enumerate(zip(nodes, attrs, strict=True)):
        t = a.get("mtime", files.get(a.get("file_uid")))
        parts = (
            0.45 * float(np.clip(vec[r.id] @ query, 0, 1)) if r.id in vec else 0.0, 0.25 * (rank[i] - rank.min()) / (rank.max() - rank.min()),
            0.15 * (sums[i] / count[i] if count[i] else 0.0), 0.15 * (0.5 if t is None else math.exp(-(now - t) / 86400 / 30)),
        )
        want[r.uid] = (sum(parts), *parts)
    got = {r.uid: tuple(r)[1:] for r in Q.queries()["hybrid_rank_all"](spark, sf).collect()}
    assert set(got) == set(want) and sum(x[1] > 0 for x in got.values()) > 100
    assert all(np.allclose(got[u], want[u], rtol=0, atol=2e-6) for u in want)


def test_vector_code_takes_linear_time(spark):
    import time

    text = "aRatherLongName with_parts and words " * 200
    took = []
    for dim in (64, 1024):
        v = spark.createDataFrame([(text,)] * 300, "t string").select(T.hashing_embedding(F.col("t"), dim).alias("v"))
        u = spark.range(2000).select(F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda x: x.cast("double") + F.col("id")).alias("v")).select(vectors.normalized(F.col("v")).alias("u"))
        began = time.perf_counter()
        assert v.select(F.sum(vectors.dot(F.col("v"), F.col("v")))).first()[0] == pytest.approx(300, rel=1e-5)
        assert u.select(F.sum(vectors.dot(F.col("u"), F.col("u")))).first()[0] == pytest.approx(2000, rel=1e-5)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 2


def test_subtokens_in_the_engine_and_in_python_agree(spark):
    texts = ["HTTPServer2 parseJSON_fast A1b AB12 x_Y__z 007 éÀb", "", None, "aB cD aB", "__init__ ABCdEF"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(F.transform(T.subtokens(F.col("t")), lambda t: T.bucket(t, 64)).alias("b"), T.hashing_embedding(F.col("t"), 64).alias("v")).collect()
    for r in rows:
        want = [float(r.b.count(k)) for k in range(64)]
        norm = math.sqrt(sum(x * x for x in want)) or 1.0
        assert r.v == pytest.approx([x / norm for x in want], abs=1e-6)


def test_a_query_builds_only_the_tables_it_reads(spark, sf):
    """And shuffles get partitions by the bytes of the tables."""
    from quillgraph import session

    at = f"{sf}/../sf0.01"
    G._BUILT.clear()
    assert G.from_tables(spark, at).nodes.count() and [k[2] for k in G._BUILT] == ["nodes"]
    assert G.from_tables(spark, at).edges.count() and [k[2] for k in G._BUILT] == ["nodes", "edges"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        session.fit(spark, *["/root/testdata/sf0.1/lineitem.parquet"] * 20)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) > 40 > int(before)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_top_k_all_moves_rows_once(spark):
    """No row is repeated for each block, whatever the number of blocks."""
    df = spark.createDataFrame([(i, 2, [1.0, float(i % 7)], "1") for i in range(200)], "node_id long, dim int, vector array<float>, type string")
    plan = vectors.top_k_all(df, 3, None, block=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and plan.count("RepartitionByExpression") == 1


def test_sales_of_a_pair_meet_before_they_are_placed(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "id long, uid string")
    rows = [("a", "b", "R", float(k), 0.5 if k % 2 else 0.9, f"s{k}", k) for k in range(6)] + [("a", "x", "R", 1.0, 1.0, "s", 9)]
    batch = spark.createDataFrame(rows, "src_uid string, dst_uid string, relation string, weight double, confidence double, source string, seq long")
    stored = spark.createDataFrame([(1, 2, "R", 7.0, 0.9, "old", None, None)], G.EDGES)
    got, missing = merges.upsert_edges(stored, batch, nodes)
    assert [(r.weight, r.confidence, r.source) for r in got.collect()] == [(7.0, 0.9, "old")] and missing.count() == 1
    got, _ = merges.upsert_edges(stored.limit(0), batch, nodes)
    assert [(r.weight, r.confidence, r.source) for r in got.collect()] == [(0.0, 0.9, "s0")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate")


def test_tokens_are_counted_in_pieces(spark, monkeypatch):
    text = "fooBar a_b fooBar HTTPServer 12 x9Y " * 50
    assert [w for p in T.words_of(text) for w in p] == re.findall(T.IDENTIFIER, text) and list(T.words_of(None)) == []
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    whole = df.select(T.subtokens(F.col("t")).alias("s")).select(F.size("s").alias("n"), F.size(F.array_distinct("s")).alias("k")).collect()
    got = df.select(T.subtoken_counts(F.col("t")).alias("c")).select("c.tokens", "c.kinds").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in whole] and got[0].tokens == 800
    monkeypatch.setattr(T, "PIECE_WORDS", 7)
    assert max(map(len, T.words_of(text))) == 7
