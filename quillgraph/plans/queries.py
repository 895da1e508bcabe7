"""Queries of the core operators over the order tables, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters, graphs, merges, metrics, ranking, relational, vectors
from ..sources import graph as G
from . import retrieval

SYMBOL = "nation:3"
SEEDS = ("nation:3", "part:7", "customer:11")
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_S: dict[str, str] = {}


def query(name: str, sql: str | None = None, graph: bool = True):
    def add(fn):
        _Q[name] = fn
        if sql:
            _S[name] = (f"WITH RECURSIVE {G.sql()}, " if graph else "WITH ") + sql.strip() if sql.strip()[:6].upper() != "SELECT" else (f"WITH RECURSIVE {G.sql()} " if graph else "") + sql.strip()
        return fn

    return add


def _ids(g: G.Graph, uids=SEEDS) -> DataFrame:
    return g.nodes.where(F.col("uid").isin(*uids)).select("id")


def _in(uids=SEEDS) -> str:
    return "(" + ", ".join(f"'{u}'" for u in uids) + ")"


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- lookup and subgraphs -------------------------------------------------------------
_REFS = """SELECT s.uid AS src_uid, s.name AS src_name, s.type AS src_type, e.relation, e.confidence, t.uid AS target_uid
FROM edges e JOIN nodes t ON e.dst = t.id JOIN nodes s ON e.src = s.id WHERE {}"""


@query("locate_refs", _REFS.format(f"t.uid = '{SYMBOL}' OR t.name = '{SYMBOL}'"))
def locate_refs(spark, sf):
    g = G.from_tables(spark, sf)
    return relational.references_to(g.nodes, g.edges, SYMBOL)


@query("locate_grouped", f"refs AS ({_REFS.format('t.uid IN ' + _in(('part:7', 'part:8')) + ' OR t.name IN ' + _in(('part:7', 'part:8')))}) SELECT target_uid, count(*) AS n, string_agg(src_uid || '|' || relation, ',' ORDER BY confidence DESC, src_uid, relation) AS refs FROM refs GROUP BY target_uid")
def locate_grouped(spark, sf):
    g = G.from_tables(spark, sf)
    refs = relational.references_to(g.nodes, g.edges, "part:7").unionAll(relational.references_to(g.nodes, g.edges, "part:8"))
    return relational.grouped_references(refs).select("target_uid", "n", F.concat_ws(",", "references").alias("refs"))


@query("locate_grounding", "tokens AS (SELECT * FROM (VALUES (0, 'unknown_symbol'), (1, 'order:5'), (2, 'part:7'), (3, 'places')) AS t(pos, token)) SELECT arg_min(token, pos) AS symbol FROM tokens WHERE token IN (SELECT uid FROM nodes UNION SELECT name FROM nodes)")
def locate_grounding(spark, sf):
    """Which word of a question names a node: the one of the best shape and length that does."""
    found = retrieval.Planner(G.from_tables(spark, sf), lambda q: []).grounded("who places part:7 in order:5 with unknown_symbol")
    return spark.createDataFrame([(found,)], "symbol string")


@query("neighborhood", f"""me AS (SELECT id FROM nodes WHERE uid = '{SYMBOL}')
SELECT 'out' AS direction, relation, uid, name, e.confidence FROM edges e JOIN me ON e.src = me.id JOIN nodes n ON n.id = e.dst
UNION ALL SELECT 'in', relation, uid, name, e.confidence FROM edges e JOIN me ON e.dst = me.id JOIN nodes n ON n.id = e.src""")
def neighborhood(spark, sf):
    g = G.from_tables(spark, sf)
    return relational.neighborhood(g.nodes, g.edges, relational.by_uid(g.nodes, SYMBOL))


def _walk(direction: str, depth: int, relations=None, seeds=SEEDS) -> str:
    where = f" WHERE relation IN {_in(relations)}" if relations else ""
    out, into = f"SELECT src AS a, dst AS b FROM edges{where}", f"SELECT dst AS a, src AS b FROM edges{where}"
    step = {"out": out, "in": into, "both": f"{out} UNION ALL {into}"}[direction]
    return f"""step AS ({step}), walk AS (SELECT id, 0 AS depth FROM nodes WHERE uid IN {_in(seeds)} UNION SELECT b, depth + 1 FROM walk JOIN step ON a = id WHERE depth < {depth}),
met AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""


def _traverse(name, direction, depth, relations=None):
    @query(name, _walk(direction, depth, relations) + " SELECT uid, depth FROM met JOIN nodes USING (id)")
    def run(spark, sf):
        g = G.from_tables(spark, sf)
        return graphs.traverse(g.nodes, g.edges, _ids(g), depth, relations, direction).join(g.nodes.select("id", "uid"), "id").select("uid", "depth")


_traverse("traverse_out", "out", 3)
_traverse("traverse_in", "in", 2)
_traverse("traverse_both", "both", 2)
_traverse("traverse_relations", "both", 3, ["LOCATED_IN", "PART_OF"])


@query("induced_subgraph", _walk("both", 1) + """ SELECT s.uid AS src, t.uid AS dst, relation, weight, e.confidence FROM edges e JOIN met a ON a.id = e.src JOIN met b ON b.id = e.dst JOIN nodes s ON s.id = e.src JOIN nodes t ON t.id = e.dst""")
def induced_subgraph(spark, sf):
    g = G.from_tables(spark, sf)
    return relational.induced(g.nodes, g.edges, graphs.traverse(g.nodes, g.edges, _ids(g), 1))


@query("induced_subgraph_ids", _walk("both", 1) + " SELECT src, dst, relation, weight, confidence FROM edges WHERE src IN (SELECT id FROM met) AND dst IN (SELECT id FROM met)")
def induced_subgraph_ids(spark, sf):
    g = G.from_tables(spark, sf)
    return relational.induced_by_id(g.edges, graphs.traverse(g.nodes, g.edges, _ids(g), 1))


# --- filters --------------------------------------------------------------------------
def _filter(name, wanted, sql, k=0):
    @query(name, sql)
    def run(spark, sf):
        g = G.from_tables(spark, sf)
        return filters.filtered(g.nodes, wanted, k)[0].select("uid", "name")


_filter("filter_attrs", {"type": "order", "lang": "1-URGENT", "color": "red"}, "SELECT uid, name FROM nodes WHERE type = 'order' AND lang = '1-URGENT'")
_filter("filter_glob", {"path_glob": "shard/1?.t*"}, "SELECT uid, name FROM nodes WHERE type <> 'file' AND file_uid GLOB 'shard/1?.t*'")
_filter("filter_since", {"since": "2001-07-20"}, "SELECT n.uid, n.name FROM nodes n JOIN nodes f ON f.type = 'file' AND f.uid = n.file_uid WHERE n.type <> 'file' AND f.mtime >= epoch(TIMESTAMP '2001-07-20')")
_filter("filter_truncated", {"type": "part"}, "SELECT uid, name FROM nodes WHERE type = 'part' ORDER BY uid LIMIT 11", 10)


# --- vectors --------------------------------------------------------------------------
def _asked(spark, sf):
    """The query vector, one row."""
    return [float(x) for x in _read(spark, sf, "embeddings").where("vec_id = 0").first().embedding]


def _top_sql(extra=""):
    return f"""SELECT query_id, node_id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS node_id,
list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank
FROM embeddings q, embeddings v WHERE true{extra}) WHERE rank <= 10"""


def _topk(name, types, extra=""):
    @query(name, _top_sql(extra), graph=False)
    def run(spark, sf):
        got = vectors.top_k_all(G.from_tables(spark, sf).embeddings, 10, types)
        return got.select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")


_topk("vector_topk", None)
_topk("vector_topk_types", ["1", "3"], " AND v.label IN (1, 3)")


@query("cosine_clamped", "SELECT vec_id AS id, round(greatest(0, least(1, list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)))), 6) AS cosine FROM embeddings", graph=False)
def cosine_clamped(spark, sf):
    g = G.from_tables(spark, sf)
    ids = g.embeddings.select(F.col("node_id").alias("id"))
    return vectors.cosines(g.embeddings, ids, _asked(spark, sf)).select("id", F.round("cosine", 6).alias("cosine"))


@query("l2_normalize", "SELECT vec_id, round(x / n, 5) + 0.0 AS first, round(sqrt(list_dot_product(v, v)) / n, 5) AS norm FROM (SELECT vec_id, v, v[1] AS x, sqrt(list_dot_product(v, v)) AS n FROM (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE * (vec_id + 2)) AS v FROM embeddings))", graph=False)
def l2_normalize(spark, sf):
    e = _read(spark, sf, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 2)))
    u = e.withColumn("u", vectors.normalized(F.col("v")))
    return u.select("vec_id", (F.round(F.col("u")[0].cast("double"), 5) + 0.0).alias("first"), F.round(F.sqrt(vectors.dot(F.col("u"), F.col("u"))), 5).alias("norm"))


@query("prevailing_dim", "SELECT len(embedding)::BIGINT AS dim, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY n DESC, dim LIMIT 1", graph=False)
def prevailing_dim(spark, sf):
    return vectors.prevailing_dim(G.from_tables(spark, sf).embeddings).select(F.col("dim").cast("long").alias("dim"), "n")


# --- aggregates and ranking -----------------------------------------------------------
_MEAN = "inc AS (SELECT dst AS id, confidence FROM edges UNION ALL SELECT src, confidence FROM edges WHERE src <> dst), mean AS (SELECT id, avg(confidence) AS confidence FROM inc GROUP BY id)"


@query("mean_incident_confidence", _MEAN + " SELECT uid, round(m.confidence, 10) AS confidence FROM mean m JOIN nodes USING (id)")
def mean_incident_confidence(spark, sf):
    g = G.from_tables(spark, sf)
    return relational.mean_incident_confidence(g.edges).join(g.nodes.select("id", "uid"), "id").select("uid", F.round("confidence", 10).alias("confidence"))


@query("corpus_clock", "SELECT max(mtime) AS now FROM nodes")
def corpus_clock(spark, sf):
    return ranking.corpus_clock(G.from_tables(spark, sf).nodes)


@query("parallel_edge_collapse", "SELECT c_custkey AS src, o_orderpriority AS dst, max(o_totalprice) AS confidence, arg_min(o_orderstatus, (-o_totalprice, o_orderstatus)) AS relation FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL", graph=False)
def parallel_edge_collapse(spark, sf):
    o = _read(spark, sf, "orders").join(_read(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return relational.strongest(o.select(F.col("c_custkey").alias("src"), F.col("o_orderpriority").alias("dst"), F.col("o_orderstatus").alias("relation"), F.col("o_totalprice").alias("confidence")))


def _degree_sql(where=""):
    return f"ends AS (SELECT DISTINCT src, dst FROM edges{where}), one AS (SELECT src AS id FROM ends UNION ALL SELECT dst FROM ends), k AS (SELECT id, count(*) AS k FROM one GROUP BY id)"


@query("degree_global", _degree_sql() + " SELECT uid, round(coalesce(k, 0) / ((SELECT count(*) FROM nodes) - 1.0), 9) AS degree FROM nodes LEFT JOIN k USING (id)")
def degree_global(spark, sf):
    g = G.from_tables(spark, sf)
    return graphs.degree(g.nodes, g.edges).join(g.nodes.select("id", "uid"), "id").select("uid", F.round("degree", 9).alias("degree"))


@query("degree_local", _walk("both", 2, ["LOCATED_IN", "PART_OF"]) + ", " + _degree_sql(" WHERE src IN (SELECT id FROM met) AND dst IN (SELECT id FROM met)") + " SELECT uid, round(coalesce(k, 0) / ((SELECT count(*) FROM met) - 1.0), 9) AS degree FROM met JOIN nodes USING (id) LEFT JOIN k USING (id)")
def degree_local(spark, sf):
    g = G.from_tables(spark, sf)
    got = graphs.centrality_scores(g.nodes, g.edges, _ids(g), 2, ["LOCATED_IN", "PART_OF"], prefer="degree")
    return got.join(g.nodes.select("id", "uid"), "id").select("uid", F.round("value", 9).alias("degree"))


def _pagerank_sql(rounds: int) -> str:
    out = """pos AS (SELECT src, dst, max(confidence) AS c FROM edges GROUP BY ALL HAVING max(confidence) > 0), tot AS (SELECT src, sum(c) AS t FROM pos GROUP BY src),
link AS (SELECT p.src, p.dst, c / t AS share FROM pos p JOIN tot USING (src)), num AS (SELECT count(*)::DOUBLE AS n FROM nodes), r0 AS (SELECT id, 1 / n AS r FROM nodes, num)"""
    for k in range(rounds):
        out += f""", d{k} AS (SELECT coalesce(sum(r), 0) AS d FROM r{k} WHERE id NOT IN (SELECT src FROM tot)), g{k} AS (SELECT dst AS id, sum(r * share) AS got FROM link JOIN r{k} ON id = src GROUP BY dst),
r{k + 1} AS MATERIALIZED (SELECT id, 0.15 / n + 0.85 * d / n + 0.85 * coalesce(got, 0) AS r FROM r{k} LEFT JOIN g{k} USING (id), num, d{k})"""
    return out + f" SELECT uid, round(r / (SELECT sum(r) FROM r{rounds}), 9) AS rank FROM r{rounds} JOIN nodes USING (id)"


@query("pagerank_fixed_rounds", _pagerank_sql(4))
def pagerank_fixed_rounds(spark, sf):
    g = G.from_tables(spark, sf)
    return graphs.pagerank(g.nodes, g.edges, rounds=4, tolerance=None).join(g.nodes.select("id", "uid"), "id").select("uid", F.round("rank", 9).alias("rank"))


def _converged_sql(rounds: int, tolerance: float) -> str:
    """As ``_pagerank_sql``; a round after the change was small enough keeps the ranks."""
    out = """pos AS (SELECT src, dst, max(confidence) AS c FROM edges GROUP BY ALL HAVING max(confidence) > 0), tot AS (SELECT src, sum(c) AS t FROM pos GROUP BY src),
link AS MATERIALIZED (SELECT p.src, p.dst, c / t AS share FROM pos p JOIN tot USING (src)), num AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM nodes),
r0 AS MATERIALIZED (SELECT id, 1 / n AS r, id IN (SELECT src FROM tot) AS linked, false AS done FROM nodes, num)"""
    for k in range(rounds):
        out += f""", d{k} AS (SELECT coalesce(sum(r) FILTER (NOT linked), 0) AS d FROM r{k}), g{k} AS (SELECT dst AS id, sum(r * share) AS got FROM link JOIN r{k} ON id = src GROUP BY dst),
n{k} AS MATERIALIZED (SELECT id, linked, done, r, CASE WHEN done THEN r ELSE 0.15 / n + 0.85 * d / n + 0.85 * coalesce(got, 0) END AS s FROM r{k} LEFT JOIN g{k} USING (id), num, d{k}),
r{k + 1} AS MATERIALIZED (SELECT id, s AS r, linked, (SELECT sum(abs(r - s)) < any_value(n) * {tolerance} FROM n{k}, num) AS done FROM n{k})"""
    return out + f" SELECT uid, round(r / (SELECT sum(r) FROM r{rounds}), 9) AS rank FROM r{rounds} JOIN nodes USING (id)"


@query("pagerank_converged", _converged_sql(45, 1e-6))
def pagerank_converged(spark, sf):
    g = G.from_tables(spark, sf)
    return graphs.pagerank(g.nodes, g.edges).join(g.nodes.select("id", "uid"), "id").select("uid", F.round("rank", 9).alias("rank"))


def _kernel(g):
    ids = graphs.traverse(g.nodes, g.edges, _ids(g, ("region:1", "region:2")), 2, ["PART_OF", "LOCATED_IN"])
    suppliers = ids.join(g.nodes.where(F.col("type").isin("region", "nation", "supplier")).select("id", "uid"), "id")
    return suppliers, g.edges


# walks of the shortest length are the shortest paths
_PATHS = (
    _walk("both", 2, ["PART_OF", "LOCATED_IN"], ("region:1", "region:2"))
    + """, kern AS MATERIALIZED (SELECT id, uid FROM met JOIN nodes USING (id) WHERE type IN ('region', 'nation', 'supplier')),
step1 AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM edges WHERE src <> dst AND src IN (SELECT id FROM kern) AND dst IN (SELECT id FROM kern)),
w1 AS (SELECT a, b, 1::DOUBLE AS n FROM step1), """
    + ", ".join(f"w{k} AS (SELECT w.a, s.b, sum(w.n) AS n FROM w{k - 1} w JOIN step1 s ON s.a = w.b GROUP BY ALL)" for k in range(2, 6))
    + ", walks AS ("
    + " UNION ALL ".join(f"SELECT a, b, {k} AS d, n FROM w{k}" for k in range(1, 6))
    + """), short AS MATERIALIZED (SELECT a, b, min(d) AS d, arg_min(n, d) AS n FROM walks WHERE a <> b GROUP BY a, b), total AS (SELECT count(*)::DOUBLE AS n FROM kern)"""
)


@query("betweenness", _PATHS + """, through AS (SELECT x.b AS id, sum(x.n * y.n / z.n) AS v FROM short x JOIN short y ON y.a = x.b JOIN short z ON z.a = x.a AND z.b = y.b WHERE x.d + y.d = z.d GROUP BY x.b)
SELECT uid, round(coalesce(v, 0) / ((total.n - 1) * (total.n - 2)), 9) AS value FROM kern LEFT JOIN through USING (id), total""")
def betweenness(spark, sf):
    g = G.from_tables(spark, sf)
    ids, edges = _kernel(g)
    return graphs.centrality(ids, relational.induced_by_id(edges, ids), "betweenness").join(ids.select("id", "uid"), "id").select("uid", F.round("value", 9).alias("value"))


@query("closeness", _PATHS + """, near AS (SELECT b AS id, count(*)::DOUBLE AS r, sum(d) AS far FROM short GROUP BY b)
SELECT uid, round(coalesce(r / far * r / (total.n - 1), 0), 9) AS value FROM kern LEFT JOIN near USING (id), total""")
def closeness(spark, sf):
    g = G.from_tables(spark, sf)
    ids, edges = _kernel(g)
    return graphs.centrality(ids, relational.induced_by_id(edges, ids), "closeness").join(ids.select("id", "uid"), "id").select("uid", F.round("value", 9).alias("value"))


@query("shortest_path", _walk("both", 4, None, ("customer:1",)) + " SELECT depth AS steps FROM met JOIN nodes USING (id) WHERE uid = 'part:7'")
def shortest_path(spark, sf):
    g = G.from_tables(spark, sf)
    a, b = (relational.by_uid(g.nodes, u).first().id for u in ("customer:1", "part:7"))
    got = graphs.shortest_path(g.nodes, g.edges, a, b, 4, "both")
    return spark.createDataFrame([(len(got) - 1,)] if got else [], "steps int")


@query("communities")
def communities(spark, sf):
    g = G.from_tables(spark, sf)
    ids, edges = _kernel(g)
    got = graphs.community_rows(ids, relational.induced_by_id(edges, ids))
    return got.join(ids.select("id", "uid"), "id").select("community", "uid")


@query("minmax_signal", "SELECT s_suppkey, round((s_acctbal - lo) / (hi - lo), 9) AS signal FROM supplier, (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)", graph=False)
def minmax_signal(spark, sf):
    return ranking.minmax(_read(spark, sf, "supplier"), "s_acctbal", "signal").select("s_suppkey", F.round("signal", 9).alias("signal"))


_REC = "clock AS (SELECT max(mtime) AS now FROM nodes), rec AS (SELECT n.id, CASE WHEN coalesce(n.mtime, f.mtime) IS NOT NULL THEN exp(-greatest(0, (now - coalesce(n.mtime, f.mtime)) / 86400) / 30) END AS r FROM clock, nodes n LEFT JOIN nodes f ON f.type = 'file' AND f.uid = n.file_uid)"


@query("recency_decay", _REC + " SELECT uid, round(coalesce(r, 0.5), 9) AS recency FROM rec JOIN nodes USING (id)")
def recency_decay(spark, sf):
    g = G.from_tables(spark, sf)
    now = ranking.corpus_clock(g.nodes).first()["now"]
    return ranking.mtimes(g.nodes).withColumn("r", ranking.recency(now)).join(g.nodes.select("id", "uid"), "id").select("uid", F.round("r", 9).alias("recency"))


@query("hybrid_rank", f"""cand AS (SELECT id FROM nodes), vec AS (SELECT {G.KINDS['order'] * G.STEP} + vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0), cos AS (SELECT id, greatest(0, least(1, list_dot_product(vec.e, q.e))) AS c FROM vec, q),
{_MEAN}, {_REC}, {_degree_sql()},
deg AS (SELECT id, coalesce(k, 0) / ((SELECT count(*) FROM cand) - 1.0) AS d FROM cand LEFT JOIN k USING (id)),
parts AS (SELECT uid, 0.45 * coalesce(c, 0) AS v, 0.25 * (d - (SELECT min(d) FROM deg)) / (SELECT max(d) - min(d) FROM deg) AS cen, 0.15 * coalesce(m.confidence, 0) AS con, 0.15 * coalesce(r, 0.5) AS rec
FROM cand JOIN nodes USING (id) LEFT JOIN cos USING (id) LEFT JOIN deg USING (id) LEFT JOIN mean m USING (id) LEFT JOIN rec USING (id))
SELECT uid, round(v + cen + con + rec, 10) AS score, round(v, 10) AS vector, round(cen, 10) AS centrality, round(con, 10) AS confidence, round(rec, 10) AS recency FROM parts""")
def hybrid_rank(spark, sf):
    """All nodes, with all vectors moved onto orders; centrality is the degree, which SQL can express."""
    g = G.from_tables(spark, sf)
    vec = g.embeddings.withColumn("node_id", F.col("node_id") + F.lit(G.KINDS["order"] * G.STEP))
    got = ranking.hybrid(g.nodes, g.edges, vec, g.nodes.select("id"), _asked(spark, sf), 0, prefer="degree")
    return got.join(g.nodes.select("id", "uid"), "id").select("uid", *(F.round(c, 10).alias(c) for c in ("score", *ranking.SIGNALS)))


@query("hybrid_rank_all")
def hybrid_rank_all(spark, sf):
    """All nodes, with all vectors moved onto orders, at the operator's depth and PageRank."""
    g = G.from_tables(spark, sf)
    vec = g.embeddings.withColumn("node_id", F.col("node_id") + F.lit(G.KINDS["order"] * G.STEP))
    got = ranking.hybrid(g.nodes, g.edges, vec, g.nodes.select("id"), _asked(spark, sf))
    return got.join(g.nodes.select("id", "uid"), "id").select("uid", *(F.round(c, 6).alias(c) for c in ("score", *ranking.SIGNALS)))


# --- merges ---------------------------------------------------------------------------
def _sales(spark, sf):
    """Lineitem as repeated edges from suppliers to parts, in arrival order."""
    li = _read(spark, sf, "lineitem")
    seq = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")
    return li.select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("src_uid"), F.concat(F.lit("part:"), (F.col("l_partkey") % 50 - 1).cast("string")).alias("dst_uid"), F.lit("SOLD").alias("relation"), F.col("l_quantity").alias("weight"), F.col("l_discount").alias("confidence"), F.col("l_returnflag").alias("source"), seq)


_SALES = "sales AS (SELECT 'supplier:' || l_suppkey AS src_uid, 'part:' || (l_partkey % 50 - 1) AS dst_uid, l_quantity AS weight, l_discount AS confidence, l_returnflag AS source, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"


@query("edge_upsert_merge", _SALES + """ SELECT src_uid, dst_uid, max(confidence) AS confidence, arg_min(weight, (-confidence, seq)) AS weight, arg_min(source, (-confidence, seq)) AS source
FROM sales WHERE src_uid IN (SELECT uid FROM nodes) AND dst_uid IN (SELECT uid FROM nodes) GROUP BY ALL""")
def edge_upsert_merge(spark, sf):
    g = G.from_tables(spark, sf)
    empty = spark.createDataFrame([], G.EDGES)
    merged, _ = merges.upsert_edges(empty, _sales(spark, sf), g.nodes)
    n = g.nodes.select("id", "uid")
    out = merged.join(n.select(F.col("id").alias("src"), F.col("uid").alias("src_uid")), "src").join(n.select(F.col("id").alias("dst"), F.col("uid").alias("dst_uid")), "dst")
    return out.select("src_uid", "dst_uid", "confidence", "weight", "source")


@query("edge_upsert_rejects", _SALES + " SELECT src_uid, dst_uid, count(*) AS n FROM sales WHERE src_uid NOT IN (SELECT uid FROM nodes) OR dst_uid NOT IN (SELECT uid FROM nodes) GROUP BY ALL")
def edge_upsert_rejects(spark, sf):
    g = G.from_tables(spark, sf)
    _, missing = merges.upsert_edges(spark.createDataFrame([], G.EDGES), _sales(spark, sf), g.nodes)
    return missing.groupBy("src_uid", "dst_uid").agg(F.count("*").alias("n"))


@query("node_upsert_merge", """stored AS (SELECT c_custkey AS id, 'c:' || c_custkey AS uid, c_name AS name, c_mktsegment AS type FROM customer), batch AS (SELECT 'c:' || o_custkey AS uid, 'Order ' || o_orderkey AS name, o_orderpriority AS type, o_orderkey AS id FROM orders),
new AS (SELECT uid, arg_max(name, id) AS name, arg_max(type, id) AS type, min(id) AS id FROM batch GROUP BY uid)
SELECT coalesce(s.id, n.id) AS id, uid, coalesce(n.name, s.name) AS name, coalesce(n.type, s.type) AS type, n.uid IS NOT NULL AS embed_dirty FROM stored s FULL JOIN new n USING (uid)""", graph=False)
def node_upsert_merge(spark, sf):
    c, o = _read(spark, sf, "customer"), _read(spark, sf, "orders")
    stored = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("uid"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.lit(False).alias("embed_dirty"))
    batch = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("uid"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("type"), F.lit(True).alias("embed_dirty"), F.col("o_orderkey").alias("seq"))
    return merges.upsert_nodes(stored, batch)


def _pending(spark, sf):
    p, o = _read(spark, sf, "part"), _read(spark, sf, "orders")
    named = p.select(F.concat(F.lit("x:"), (F.col("p_partkey") % 97).cast("string")).alias("src_uid"), F.concat(F.lit("f"), (F.col("p_partkey") % 7).cast("string")).alias("src_file"), F.col("p_name").alias("dst_name"), F.lit("CALLS").alias("relation"), (F.col("p_size") / 100.0).alias("confidence"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))).alias("dst_uid"), F.when(F.col("p_size") % 2 == 0, F.lit("ast")).alias("source"), F.col("p_partkey").alias("seq"))
    return named.unionAll(o.select(F.lit("x:1"), F.lit("f9"), F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), F.lit("CALLS"), F.lit(0.3), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("o_orderkey")))


_PEND = """pend AS (SELECT 'x:' || p_partkey % 97 AS src_uid, 'f' || p_partkey % 7 AS src_file, p_name AS dst_name, 'CALLS' AS relation, p_size / 100.0 AS confidence, CASE WHEN p_partkey % 3 = 0 THEN 'part:' || p_partkey END AS dst_uid, CASE WHEN p_size % 2 = 0 THEN 'ast' END AS source, p_partkey AS seq FROM part
UNION ALL SELECT 'x:1', 'f9', 'Order#' || o_orderkey, 'CALLS', 0.3, NULL, NULL, o_orderkey FROM orders),
merged AS (SELECT src_uid, arg_max(src_file, seq) AS src_file, dst_name, relation, max(confidence)::DOUBLE AS confidence, arg_max(dst_uid, seq) FILTER (dst_uid IS NOT NULL) AS dst_uid, arg_max(source, seq) FILTER (source IS NOT NULL) AS source FROM pend GROUP BY src_uid, dst_name, relation)"""


@query("pending_upsert", _PEND + " SELECT * FROM merged")
def pending_upsert(spark, sf):
    return merges.upsert_pending(spark.createDataFrame([], G.PENDING), _pending(spark, sf))


@query("pending_resolve", _PEND + """, names AS (SELECT name, min(uid) AS by_name FROM nodes WHERE type <> 'file' GROUP BY name HAVING count(*) = 1)
SELECT src_uid, dst_name, confidence, CASE WHEN m.dst_uid IS NOT NULL THEN u.uid ELSE by_name END AS to_uid FROM merged m LEFT JOIN names ON name = dst_name LEFT JOIN (SELECT uid FROM nodes) u ON u.uid = m.dst_uid""")
def pending_resolve(spark, sf):
    g = G.from_tables(spark, sf)
    return merges.resolve_pending(merges.upsert_pending(spark.createDataFrame([], G.PENDING), _pending(spark, sf)), g.nodes).select("src_uid", "dst_name", "confidence", "to_uid")


_GONE = "gone AS (SELECT id FROM nodes WHERE uid IN ('shard/01.tbl', 'shard/02.tbl') OR file_uid IN ('shard/01.tbl', 'shard/02.tbl'))"


def _deleted(spark, sf):
    g = G.from_tables(spark, sf)
    files = spark.createDataFrame([("shard/01.tbl",), ("shard/02.tbl",)], "uid string")
    return merges.delete_files(g.nodes.withColumn("embed_dirty", F.lit(False)), g.edges, files)


@query("cascade_delete", _GONE + " SELECT relation, count(*) AS n, round(sum(weight), 2) AS weight FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY relation")
def cascade_delete(spark, sf):
    return _deleted(spark, sf)[1].groupBy("relation").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 2).alias("weight"))


@query("dirty_neighbors", _GONE + ", far AS (SELECT dst AS id FROM edges WHERE src IN (SELECT id FROM gone) UNION SELECT src FROM edges WHERE dst IN (SELECT id FROM gone)) SELECT uid FROM nodes WHERE id IN (SELECT id FROM far) AND id NOT IN (SELECT id FROM gone)")
def dirty_neighbors(spark, sf):
    return _deleted(spark, sf)[0].where("embed_dirty").select("uid")


@query("status_counts", "SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'files', count(*) FROM nodes WHERE type = 'file'")
def status_counts(spark, sf):
    g = G.from_tables(spark, sf)
    return relational.table_counts({"nodes": g.nodes, "edges": g.edges, "embeddings": g.embeddings, "files": g.nodes.where("type = 'file'")})


# --- text, packing, metrics -----------------------------------------------------------
_COST = "cost AS (SELECT doc_id, source, greatest(1, (length(text) + 3) // 4) AS cost FROM documents)"


@query("token_cost", _COST + " SELECT doc_id, cost FROM cost", graph=False)
def token_cost(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", T.token_cost(F.col("text")).alias("cost"))


@query("pack_prefix", _COST + " SELECT doc_id, cost, run::BIGINT AS run FROM (SELECT doc_id, cost, sum(cost) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM cost) WHERE run <= 5000", graph=False)
def pack_prefix(spark, sf):
    d = _read(spark, sf, "documents").select("doc_id", "source", T.token_cost(F.col("text")).alias("cost"))
    return ranking.within_budget(d, "source", "doc_id", "cost", 5000).select("doc_id", "cost", "run")


@query("doc_ordinals", "SELECT doc_id, CASE WHEN k = 0 THEN source ELSE source || '#' || k END AS uid FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents)", graph=False)
def doc_ordinals(spark, sf):
    return merges.ordinal_uids(_read(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "uid")


@query("keep_first", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1", graph=False)
def keep_first(spark, sf):
    return relational.keep_first(_read(spark, sf, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("neighborhood_names", """far AS (SELECT src AS id, lower(relation) AS relation, dst AS far FROM edges UNION ALL SELECT dst, lower(relation) || '_by', src FROM edges),
named AS (SELECT DISTINCT f.id, f.relation, n.name FROM far f JOIN nodes n ON n.id = f.far), top AS (SELECT *, row_number() OVER (PARTITION BY id, relation ORDER BY name) AS k FROM named)
SELECT uid, relation, string_agg(top.name, '; ' ORDER BY top.name) AS names FROM top JOIN nodes USING (id) WHERE k <= 25 GROUP BY uid, relation""")
def neighborhood_names(spark, sf):
    g = G.from_tables(spark, sf)
    return relational.relation_names(g.nodes, g.edges).join(g.nodes.select("id", "uid"), "id").select("uid", "relation", F.concat_ws("; ", "names").alias("names"))


# DuckDB's patterns look at nothing ahead, so a capital that starts a part is set apart first
_TOKENS = r"""words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) AS w FROM documents),
part AS (SELECT doc_id, w, unnest(regexp_extract_all(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z][a-z][a-z0-9]*|[A-Z]+|[a-z0-9]+')) AS p FROM words),
token AS (SELECT doc_id, lower(w) AS t FROM words UNION ALL SELECT doc_id, lower(p) FROM part WHERE lower(p) <> lower(w))"""


@query("hashing_embed", _TOKENS + """, many AS (SELECT doc_id, ('0x' || right(md5(t), 2))::BIGINT AS bucket, count(*)::DOUBLE AS c FROM token GROUP BY ALL),
size AS (SELECT doc_id, sqrt(sum(c * c)) AS s FROM many GROUP BY doc_id) SELECT doc_id, bucket, (c / s)::FLOAT::DOUBLE AS value FROM many JOIN size USING (doc_id)""", graph=False)
def hashing_embed(spark, sf):
    """What isn't zero of the vectors of all documents, at the engine's dimension."""
    v = _read(spark, sf, "documents").select("doc_id", T.hashing_embedding(F.col("text"), 256).alias("v"))
    return v.select("doc_id", F.posexplode("v").alias("bucket", "x")).where("x <> 0").select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.col("x").cast("double").alias("value"))


@query("subtoken_counts", _TOKENS + " SELECT doc_id, count(*) AS tokens, count(DISTINCT t) AS kinds FROM token GROUP BY doc_id", graph=False)
def subtoken_counts(spark, sf):
    d = _read(spark, sf, "documents").select("doc_id", T.subtoken_counts(F.col("text")).alias("t"))
    return d.select("doc_id", "t.tokens", "t.kinds").where("tokens > 0")


@query("json_extract_props", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events", graph=False)
def json_extract_props(spark, sf):
    return _read(spark, sf, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as double)").alias("k"))


@query("intent_route", r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\b(?:where|who|which)\b.*\b(?:use[ds]?|call(?:s|ed)?|references?|invokes?)\b') THEN 'LOCATE' ELSE 'EXPLAIN' END AS intent FROM conversations", graph=False)
def intent_route(spark, sf):
    return _read(spark, sf, "conversations").select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))


def _cases(spark, sf):
    """A case for each customer: returned are its orders by price, expected its open ones with their priority as gain."""
    o = _read(spark, sf, "orders")
    uid = (F.col("o_orderkey") % 1000).cast("string").alias("uid")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    returned = o.select(F.col("o_custkey").alias("case_id"), uid, pos.alias("pos"))
    expected = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("case_id"), uid, F.substring("o_orderpriority", 1, 1).cast("double").alias("gain"))
    return _read(spark, sf, "customer").select(F.col("c_custkey").alias("case_id")), returned, expected


_CASES = """cases AS (SELECT c_custkey AS case_id FROM customer), o AS (SELECT * FROM orders),
returned AS (SELECT o_custkey AS case_id, (o_orderkey % 1000)::VARCHAR AS uid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM o),
expected AS (SELECT o_custkey AS case_id, (o_orderkey % 1000)::VARCHAR AS uid, max(substr(o_orderpriority, 1, 1)::DOUBLE) AS gain FROM o WHERE o_orderstatus = 'O' GROUP BY ALL)"""


@query("metrics_precision_recall", _CASES + """, r AS (SELECT DISTINCT case_id, uid FROM returned),
n AS (SELECT case_id, count(*) AS n FROM r GROUP BY case_id), m AS (SELECT case_id, count(*) AS m FROM expected GROUP BY case_id), h AS (SELECT case_id, count(*) AS hit FROM r JOIN expected USING (case_id, uid) GROUP BY case_id),
s AS (SELECT case_id, coalesce(n, 0) AS n, coalesce(m, 0) AS m, coalesce(hit, 0) AS hit FROM cases LEFT JOIN n USING (case_id) LEFT JOIN m USING (case_id) LEFT JOIN h USING (case_id)),
pr AS (SELECT case_id, CASE WHEN n = 0 THEN 0 ELSE hit / n END AS p, CASE WHEN m = 0 THEN 1 ELSE hit / m END AS r FROM s)
SELECT case_id, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM pr""", graph=False)
def metrics_precision_recall(spark, sf):
    got = metrics.set_metrics(*_cases(spark, sf))
    return got.select("case_id", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("metrics_rank", _CASES + """, d AS (SELECT case_id, uid, min(pos) AS pos FROM returned GROUP BY ALL), rk AS (SELECT case_id, uid, row_number() OVER (PARTITION BY case_id ORDER BY pos, uid) AS rank FROM d),
h AS (SELECT case_id, count(*) FILTER (rank <= 10) AS hit, 1.0 / min(rank) AS mrr, sum(gain / log2(rank + 1)) FILTER (rank <= 10) AS dcg FROM rk JOIN expected USING (case_id, uid) GROUP BY case_id),
ideal AS (SELECT case_id, count(*) AS m, sum(gain / log2(place + 1)) FILTER (place <= 10) AS best FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY gain DESC, uid) AS place FROM expected) GROUP BY case_id)
SELECT case_id, round(CASE WHEN coalesce(m, 0) = 0 THEN 1 ELSE coalesce(hit, 0) / m END, 9) AS recall_at_k, round(coalesce(mrr, 0), 9)::DOUBLE AS mrr, round(CASE WHEN coalesce(best, 0) = 0 THEN 0 ELSE coalesce(dcg, 0) / best END, 9) AS ndcg
FROM cases LEFT JOIN h USING (case_id) LEFT JOIN ideal USING (case_id)""", graph=False)
def metrics_rank(spark, sf):
    got = metrics.rank_metrics(*_cases(spark, sf))
    return got.select("case_id", *(F.round(c, 9).alias(c) for c in ("recall_at_k", "mrr", "ndcg")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)
