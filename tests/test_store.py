import pytest
from pyspark.sql import functions as F

import quillgraph
from quillgraph.plans import ingest
from quillgraph.sources import graph as G
from quillgraph.sources import store as S


def test_exported_names():
    assert all(getattr(quillgraph, n) is not None for n in quillgraph.__all__)
    with pytest.raises(AttributeError):
        quillgraph.nothing  # noqa: B018


def test_migrations(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "store")
    old = S.Store(spark, at)
    none = lambda t: spark.createDataFrame([], S.TABLES[t])
    nodes = none("nodes").unionByName(spark.createDataFrame([(1, "a", "class", "a")], "id long, uid string, type string, name string"), allowMissingColumns=True)
    old.save(G.Graph(nodes, none("edges"), none("embeddings"), none("pending")), {"k": 1})
    monkeypatch.setattr(S, "VERSION", 3)

    def fails(tables):
        raise ValueError("step 2")

    upper = lambda tables: tables | {"nodes": tables["nodes"].withColumn("name", F.upper("name"))}
    monkeypatch.setattr(S, "STEPS", {1: upper, 2: fails})
    with pytest.raises(ValueError):
        S.Store(spark, at)
    assert old.state()["version"] == 2 and old.load().nodes.first().name == "A"  # the step before stays
    monkeypatch.setitem(S.STEPS, 2, lambda tables: tables)
    new = S.Store(spark, at)
    assert new.state()["version"] == 3 and new.load().nodes.first().name == "A" and new.get_meta("k") == 1
    monkeypatch.setattr(S, "VERSION", 2)
    with pytest.raises(RuntimeError):
        S.Store(spark, at)


def test_embedding_in_batches(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(1)
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [[1.0, 0.0]] * (len(texts) - any("few" in t for t in texts))

    rows = [(k, f"n{k}", "class", t) for k, t in enumerate(["ok", "fine", "bad", "well", "few", "good"])]
    nodes = spark.createDataFrame(rows, "id long, uid string, type string, name string").withColumns({"body": F.lit(None).cast("string"), "attrs": F.lit("{}"), "embed_dirty": F.lit(True)}).coalesce(1)
    empty = lambda t: spark.createDataFrame([], S.TABLES[t])
    plain = lambda n, e: n.select("id", F.col("name").alias("text"))
    graph, n = ingest.refresh(G.Graph(nodes, empty("edges"), empty("embeddings"), empty("pending")), ingest.batched(embed, 2, size=1), "m", serialize=plain)
    assert n == 4 and calls.value == 8  # the two that fail are tried twice
    assert sorted(r.name for r in graph.nodes.where("embed_dirty").collect()) == ["bad", "few"]
    assert graph.embeddings.count() == 4
