import decimal
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from quillgraph.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, sf, con, name):
    df = Q.queries()[name](spark, sf)
    got = con.execute(Q.oracle_sql()[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in got.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_others_give_rows(spark, sf, name):
    assert Q.queries()[name](spark, sf).count() > 0


def test_entry_works_without_the_training_data_folders(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/quillgraph", tmp_path / "quillgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    (tmp_path / "quillgraph" / "llm").mkdir()
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(x.startswith('op') for x in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=100)
    assert out.stdout.split()[1:] == ["False", "True"], out.stderr


def test_filters_and_columns_reach_the_scan(spark, sf):
    from quillgraph.operators import relational
    from quillgraph.sources import graph

    g = graph.from_tables(spark, sf)
    plan = relational.references_to(g.nodes, g.edges, "nation:3")._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan and "l_tax" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["metrics_precision_recall", "metrics_rank"])
def test_metrics_have_a_case_for_every_customer(spark, sf, name):
    customers = {r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()}
    assert {r.case_id for r in Q.queries()[name](spark, sf).select("case_id").collect()} == customers


@pytest.mark.parametrize("name", ["pending_upsert", "pending_resolve"])
def test_every_order_is_pending(spark, sf, name):
    orders = {f"Order#{r.o_orderkey}" for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()}
    assert {r.dst_name for r in Q.queries()[name](spark, sf).select("dst_name").collect()} >= orders
