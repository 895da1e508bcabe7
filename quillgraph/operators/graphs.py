"""Traversal and graph algorithms.

Whole-graph algorithms are joins and aggregates with a checkpoint for each
round. Edge lists go to tasks or to the driver only after a count against a
ceiling; beyond it betweenness and closeness are joins over pairs of nodes, and
communities are taken component by component.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from fractions import Fraction
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bucketed, cut, sized, small
from .relational import induced_by_id, strongest

CEILING_NODES = 2_000
CEILING_EDGES = 250_000


def adjacency(edges: DataFrame, relations: list[str] | None = None, direction: str = "both") -> DataFrame:
    """(at, to) steps in a direction; an empty list of relations is no filter."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction must be out, in or both, not {direction!r}")
    if relations:
        edges = edges.where(F.col("relation").isin(list(relations)))
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    into = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"))
    return out if direction == "out" else into if direction == "in" else out.unionAll(into)


def traverse(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 2, relations: list[str] | None = None, direction: str = "both") -> DataFrame:
    """(id, depth) of nodes within ``max_depth`` steps of ``seeds`` (id), at least depth; seeds that are no nodes are dropped.

    Each round joins the frontier with the steps, and keeps what no earlier
    round has met; it ends early when a frontier is empty.
    """
    step = adjacency(edges, relations, direction)
    front = cut(nodes.join(small(seeds.select("id").distinct()), "id", "left_semi").select("id", F.lit(0).alias("depth")))
    met, size = front, front.count()
    total = size
    for depth in range(1, max_depth + 1):
        if not size:
            break
        # sizes are those of written rows, so a side is broadcast only where it is known to be small
        near = step.join(sized(front.select(F.col("id").alias("at")), size), "at").select(F.col("to").alias("id"))
        # repeats go before the shuffle that the rows met so far wait for
        front = cut(near.distinct().join(sized(met.select("id"), total), "id", "left_anti").select("id", F.lit(depth).alias("depth")))
        met, size = met.unionAll(front), front.count()
        total += size
    return met


def subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, relations: list[str] | None = None, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """(nodes (id), edges (src, dst, relation, confidence), one for each pair) around the seeds."""
    ids = traverse(nodes, edges, seeds, depth, relations, direction).select("id")
    return ids, strongest(induced_by_id(edges, ids))


def pagerank(ids: DataFrame, edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(id, rank) by power iteration, weights are confidences; rows of weight <= 0 are ignored.

    Dangling mass goes to all evenly. It stops when the summed change is under
    n * tolerance (never, with None), and divides by the sum at the end. No
    ceiling: a round is one join and one aggregate, written to a checkpoint.
    Links lie in buckets by ``src``, so that no round moves them.
    """
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    # rows of a source meet once: the strongest of a pair, the sum of a source and its bucket need no other shuffle
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = edges.where("confidence > 0").select("src", "dst", "confidence").repartition(parts, "src").groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
    links = bucketed(best, "src", parts)
    sources = links.groupBy(F.col("src").alias("id")).agg(F.sum("confidence").alias("out"))
    now = cut(ids.select("id").distinct().join(sources, "id", "left").select("id", F.lit(1.0 / n).alias("rank"), "out"))
    loose = F.sum(F.when(F.col("out").isNull(), F.col("rank")))
    dangling, total = now.agg(loose, F.sum("rank")).first()
    for _ in range(rounds):
        rest = (1 - alpha) / n + alpha * (dangling or 0.0) / n
        sent = links.join(sized(now.where("out is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("out")).alias("part")), n), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("part") * F.col("confidence")).alias("got"))
        new = cut(now.join(sent, "id", "left").select("id", (F.lit(rest) + alpha * F.coalesce("got", F.lit(0.0))).alias("rank"), "out", F.col("rank").alias("before")))
        # one small aggregate of written rows for all that the next round needs
        change, dangling, total = new.agg(F.sum(F.abs(F.col("rank") - F.col("before"))), loose, F.sum("rank")).first()
        now = new.drop("before")
        if tolerance is not None and change < n * tolerance:
            break
    return now.select("id", (F.col("rank") / total).alias("rank"))


def degree(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): distinct ordered pairs in and out over n - 1; a loop counts twice; 1.0 if there is one node."""
    n = ids.count()
    ends = edges.select("src", "dst").distinct().select(F.explode(F.array("src", "dst")).alias("id"))
    count = ends.groupBy("id").agg(F.count("*").alias("k"))
    value = F.lit(1.0) if n <= 1 else F.coalesce(F.col("k"), F.lit(0)) / F.lit(float(n - 1))
    return ids.select("id").join(count, "id", "left").select("id", value.alias("degree"))


def bounded(ids: DataFrame, edges: DataFrame, nodes_most: int = CEILING_NODES, edges_most: int = CEILING_EDGES) -> tuple[list[int], list[tuple[int, int, float]]]:
    """The subgraph on the driver; ValueError beyond the ceilings."""
    n = [r.id for r in ids.select("id").distinct().limit(nodes_most + 1).collect()]
    e = [tuple(r) for r in strongest(edges).select("src", "dst", "confidence").limit(edges_most + 1).collect()]
    if len(n) > nodes_most or len(e) > edges_most:
        raise ValueError(f"graph exceeds {nodes_most} nodes or {edges_most} edges")
    have = set(n)
    return sorted(n), sorted(x for x in e if x[0] in have and x[1] in have)


def centrality(ids: DataFrame, edges: DataFrame, kind: str = "betweenness") -> DataFrame:
    """(id, value): unweighted betweenness (Brandes) or closeness (incoming, with the share reached), one source a step, spread over tasks.

    A graph beyond the ceilings never leaves the tables: ``_centrality_by_pairs``.
    """
    if kind not in ("betweenness", "closeness"):
        raise ValueError(f"unknown kind {kind!r}")
    try:
        n, e = bounded(ids, edges)
    except ValueError:
        return _centrality_by_pairs(ids, edges, kind)
    spark = ids.sparkSession
    to: dict[int, list[int]] = defaultdict(list)
    for a, b, _ in e:
        if a != b:
            (to[a] if kind == "betweenness" else to[b]).append(b if kind == "betweenness" else a)

    def run(frames):
        for frame in frames:
            out: dict[int, float] = defaultdict(float)
            for s in frame["id"].tolist():
                dist, order, paths, parents = {s: 0}, [], defaultdict(float), defaultdict(list)
                paths[s] = 1.0
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for x in to.get(v, ()):
                        if x not in dist:
                            dist[x] = dist[v] + 1
                            queue.append(x)
                        if dist[x] == dist[v] + 1:
                            paths[x] += paths[v]
                            parents[x].append(v)
                if kind == "closeness":
                    total = sum(dist.values())
                    out[s] = (len(dist) - 1) / total * (len(dist) - 1) / (len(n) - 1) if total and len(n) > 1 else 0.0
                    continue
                out[s] += 0.0
                owed: dict[int, float] = defaultdict(float)
                for x in reversed(order):
                    for v in parents[x]:
                        owed[v] += paths[v] / paths[x] * (1 + owed[x])
                    if x != s:
                        out[x] += owed[x]
            yield pd.DataFrame({"id": list(out), "value": list(out.values())})

    sources = spark.createDataFrame([(x,) for x in n], "id long") if n else ids.select("id").limit(0)
    got = sources.repartition(8).mapInPandas(run, "id long, value double").groupBy("id").agg(F.sum("value").alias("value"))
    scale = 1.0 / ((len(n) - 1) * (len(n) - 2)) if kind == "betweenness" and len(n) > 2 else 1.0
    return got.select("id", (F.col("value") * scale).alias("value"))


def _centrality_by_pairs(ids: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """``centrality`` by joins: a round for each distance, over rows (s, v, paths) of the pairs at that distance, and back.

    Rows are as many as pairs that reach each other, so in the worst case the
    square of the nodes; they lie in checkpoints and are spread over all tasks.
    """
    ids = cut(ids.select("id").distinct())
    n = ids.count()
    step = cut(induced_by_id(edges, ids).where("src <> dst").select("src", "dst").distinct())
    near = sized(step, step.count())
    met = ids.select(F.col("id").alias("s"), F.col("id").alias("v"))
    levels = [met.withColumn("paths", F.lit(1.0))]
    while True:
        reached = levels[-1].join(near, F.col("v") == F.col("src")).groupBy("s", "dst").agg(F.sum("paths").alias("paths"))
        new = cut(reached.withColumnRenamed("dst", "v").join(met, ["s", "v"], "left_anti"))
        if new.isEmpty():
            break
        met = met.unionAll(new.select("s", "v"))
        levels.append(new)
    if kind == "closeness":
        far = [x.groupBy("v").agg(F.count("*").alias("r"), F.count("*").alias("d")).withColumn("d", F.col("d") * k) for k, x in enumerate(levels) if k]
        both = reduce(DataFrame.unionAll, far, levels[0].limit(0).selectExpr("v", "0L as r", "0L as d")).groupBy(F.col("v").alias("id")).agg(F.sum("r").alias("r"), F.sum("d").alias("d"))
        value = F.col("r") / F.col("d") * F.col("r") / F.lit(float(max(n - 1, 1)))
        return ids.join(both, "id", "left").select("id", F.coalesce(value, F.lit(0.0)).alias("value"))
    got, owed = [], None
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k].withColumn("owed", F.lit(0.0)) if owed is None else levels[k].join(owed, ["s", "v"], "left").fillna(0.0, ["owed"])
        got.append(here.groupBy(F.col("v").alias("id")).agg(F.sum("owed").alias("value")))
        back = here.join(near, F.col("v") == F.col("dst")).select("s", F.col("src").alias("v"), ((1 + F.col("owed")) / F.col("paths")).alias("part"))
        owed = back.join(levels[k - 1], ["s", "v"]).groupBy("s", "v").agg((F.first("paths") * F.sum("part")).alias("owed"))
        owed = cut(owed) if k > 1 else None
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    sums = reduce(DataFrame.unionAll, got, ids.limit(0).withColumn("value", F.lit(0.0))).groupBy("id").agg(F.sum("value").alias("value"))
    return ids.join(sums, "id", "left").select("id", (F.coalesce("value", F.lit(0.0)) * F.lit(scale)).alias("value"))


def shortest_path(nodes: DataFrame, edges: DataFrame, start: int, goal: int, max_depth: int = 6, direction: str = "out") -> list[int] | None:
    """Ids of a shortest path of at most ``max_depth`` steps, or None; of several, the smallest by ids."""
    spark = nodes.sparkSession
    if nodes.where(F.col("id").isin(start, goal)).select("id").distinct().count() < (1 if start == goal else 2):
        return None
    if start == goal:
        return [start]
    step = adjacency(edges, None, direction)
    one = lambda x: cut(spark.createDataFrame([(x,)], "id long"))

    def before(level: DataFrame, size: int) -> DataFrame:
        return step.join(sized(level.withColumnRenamed("id", "to"), size), "to").select(F.col("at").alias("id")).distinct()

    def after(level: DataFrame, size: int) -> DataFrame:
        return step.join(sized(level.withColumnRenamed("id", "at"), size), "at").select(F.col("to").alias("id")).distinct()

    # levels grow from both ends, the smaller one first, until they meet; rows are ids, never paths
    ends = {after: [(one(start), 1)], before: [(one(goal), 1)]}
    for _ in range(max_depth):
        grow, other = (after, before) if ends[after][-1][1] <= ends[before][-1][1] else (before, after)
        met = reduce(DataFrame.unionAll, (x for x, _ in ends[grow]))
        new = cut(grow(*ends[grow][-1]).join(sized(met, sum(k for _, k in ends[grow])), "id", "left_anti"))
        size = new.count()
        if not size:
            return None
        ends[grow].append((new, size))
        (far, k) = ends[other][-1]
        meet = cut(new.join(sized(far, k), "id", "left_semi"))
        if not meet.isEmpty():
            break
    else:
        return None
    here, there = ends[after], ends[before]
    on = {len(here) - 1: (meet, meet.count())} | {len(here) + k: x for k, x in enumerate(there[-2::-1])}
    for k in range(len(here) - 2, 0, -1):  # those of a level that lead to where the ends meet
        level = cut(here[k][0].join(before(*on[k + 1]), "id", "left_semi"))
        on[k] = level, level.count()
    path = [start]
    for k in range(1, len(here) + len(there) - 1):
        level, size = on[k]
        path.append(step.where(F.col("at") == path[-1]).join(sized(level.withColumnRenamed("id", "to"), size), "to", "left_semi").agg(F.min("to").alias("to")).first().to)
    return path


def components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that is connected with ``id``, in any direction."""
    step = cut(adjacency(induced_by_id(edges, ids)).where("at <> to").distinct())
    now = cut(ids.select("id").distinct().withColumn("component", F.col("id")))
    while True:
        seen = step.join(now.withColumnRenamed("id", "to"), "to").groupBy(F.col("at").alias("id")).agg(F.min("component").alias("near"))
        least = now.join(seen, "id", "left").select("id", "component", F.least("component", "near").alias("least"))
        # a component's name has a name itself, so that far ends meet in few rounds
        jump = now.select(F.col("id").alias("least"), F.col("component").alias("beyond"))
        new = cut(least.join(jump, "least").select("id", F.col("beyond").alias("component"), (F.col("beyond") < F.col("component")).alias("moved")))
        now = new.select("id", "component")
        if new.where("moved").isEmpty():
            return now


def greedy_modularity(nodes: list[int], edges: list[tuple[int, int, float]], total: Fraction) -> list[list[int]]:
    """Communities of one component of a graph whose degrees sum up to ``total``; ``edges`` are undirected, one for each pair.

    Gains are exact, so ties are ties. A pair is kept by its end of more
    neighbours, sorted by what its gain depends on beside that end's own degree:
    when a hub grows, none of its pairs has to move.
    """
    scale = max([total.denominator, *(Fraction(c).denominator for _, _, c in edges)])  # all are powers of two
    t = int(total * scale)
    w: dict[int, dict[int, int]] = {x: {} for x in nodes}
    for a, b, c in edges:
        w[a][b] = w[b][a] = int(Fraction(c) * scale)
    k = {x: sum(to.values()) for x, to in w.items()}
    label, members = {x: x for x in nodes}, {x: [x] for x in nodes}
    mine: dict[int, dict[int, tuple[int, int]]] = {x: {} for x in nodes}
    theirs: dict[int, set[int]] = {x: set() for x in nodes}
    groups: dict[int, dict[tuple[int, int], list[tuple[int, int]]]] = {x: {} for x in nodes}
    version, heap = dict.fromkeys(nodes, 0), []

    def put(a: int, x: int) -> None:
        mine[a][x] = key = (k[x], w[a][x])
        heapq.heappush(groups[a].setdefault(key, []), (label[x], x))

    def push(a: int) -> None:
        version[a] += 1
        best = None
        for key, xs in list(groups[a].items()):
            while xs and (mine[a].get(xs[0][1]) != key or label[xs[0][1]] != xs[0][0]):
                heapq.heappop(xs)
            if not xs:
                del groups[a][key]
            elif best is None or (key[0] * k[a] - key[1] * t, xs[0]) < best:
                best = (key[0] * k[a] - key[1] * t, xs[0])
        if best:
            loss, (name, x) = best
            heapq.heappush(heap, (loss, min(label[a], name), max(label[a], name), a, x, version[a]))

    for a in nodes:
        for x in w[a]:
            if (len(w[a]), a) > (len(w[x]), x):
                put(a, x)
                theirs[x].add(a)
    for a in nodes:
        push(a)
    while heap:
        loss, _, _, a, b, at = heapq.heappop(heap)
        if version.get(a) != at:
            continue
        if -2 * loss / (t * t) <= 1e-12:
            break
        if len(w[b]) > len(w[a]):
            a, b = b, a
        for x, y in ((a, b), (b, a)):
            mine[x].pop(y, None)
            theirs[x].discard(y)
            w[x].pop(y)
        k[a] += k.pop(b)
        label[a] = min(label[a], label.pop(b))
        members[a] += members.pop(b)
        again = {a}
        for x, c in w.pop(b).items():
            del w[x][b]
            if x in mine[b]:
                theirs[x].discard(b)
            else:
                mine[x].pop(b)
                again.add(x)
            if x not in w[a]:
                (theirs[x] if x in mine[b] else theirs[a]).add(a if x in mine[b] else x)
            w[a][x] = w[x][a] = w[a].get(x, 0) + c
            if x not in theirs[a]:
                put(a, x)
        del mine[b], theirs[b], groups[b], version[b]
        for x in theirs[a]:
            put(x, a)
        for x in again | theirs[a]:
            push(x)
    return sorted((sorted(m) for m in members.values()), key=lambda m: (-len(m), m))


def _total(pairs: list[float]) -> Fraction:
    return 2 * sum(map(Fraction, pairs), Fraction(0))


def community_rows(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, id): greedy modularity on the undirected confidences, which joins the pair with the greatest gain (smallest ids if tied) while there is a gain.

    Communities are numbered from 0, largest first, then by members. A merge is
    felt only inside its component, so beyond the ceilings each component is one
    task; it is held by that task, as its merges are one after another.
    """
    spark = ids.sparkSession
    try:
        n, e = bounded(ids, edges)
    except ValueError:
        rows = _communities_by_component(ids, edges)
    else:
        weight: dict[tuple[int, int], float] = {}
        for a, b, c in e:
            if a != b and c > 0:
                weight[min(a, b), max(a, b)] = max(weight.get((min(a, b), max(a, b)), 0.0), c)
        got = greedy_modularity(n, [(a, b, c) for (a, b), c in weight.items()], _total(list(weight.values()))) if weight else [[x] for x in n]
        return spark.createDataFrame([(j, x) for j, m in enumerate(got) for x in m], "community int, id long")
    sizes = rows.groupBy("first").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "first").select("first")
    numbers = sizes.rdd.zipWithIndex().map(lambda x: (x[1], x[0][0])).toDF("community int, first long")
    return rows.join(numbers, "first").select("community", "id")


def _communities_by_component(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(first, id): the smallest id of the community of each id."""
    ids = cut(ids.select("id").distinct())
    low, high = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    pairs = cut(induced_by_id(edges, ids).where("src <> dst and confidence > 0").groupBy(low, high).agg(F.max("confidence").alias("c")))
    # each different value once, so that the exact sum takes few rows
    total = 2 * sum((Fraction(r.c) * r.n for r in pairs.groupBy("c").agg(F.count("*").alias("n")).toLocalIterator()), Fraction(0))
    part = components(ids, pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rows = part.select("component", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("c"))
    rows = rows.unionAll(pairs.join(part.withColumnRenamed("id", "a"), "a").select("component", "a", "b", "c"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        alone, joined = frame[frame["b"].isna()], frame[frame["b"].notna()]
        e = list(zip(joined["a"].tolist(), joined["b"].astype("int64").tolist(), joined["c"].tolist(), strict=True))
        got = greedy_modularity(alone["a"].tolist(), e, total) if e else [[x] for x in alone["a"].tolist()]
        return pd.DataFrame({"first": [m[0] for m in got for _ in m], "id": [x for m in got for x in m]}, dtype="int64")

    return cut(rows.groupBy("component").applyInPandas(run, "first long, id long"))


def communities(ids: DataFrame, edges: DataFrame) -> list[list[int]]:
    """``community_rows`` as lists on the driver."""
    out: dict[int, list[int]] = defaultdict(list)
    for r in community_rows(ids, edges).collect():
        out[r.community].append(r.id)
    return [sorted(out[k]) for k in sorted(out)]


def centrality_scores(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, relations: list[str] | None = None, direction: str = "both", prefer: str = "pagerank") -> DataFrame:
    """(id, value) of PageRank or degree on the subgraph around the seeds."""
    prefer = str(prefer).lower()
    if prefer not in ("pagerank", "degree"):
        raise ValueError(f"prefer must be pagerank or degree, not {prefer!r}")
    ids, inner = subgraph(nodes, edges, seeds, depth, relations, direction)
    return pagerank(ids, inner).withColumnRenamed("rank", "value") if prefer == "pagerank" else degree(ids, inner).withColumnRenamed("degree", "value")
