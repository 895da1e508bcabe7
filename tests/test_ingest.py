import json
import os

import pytest

from quillgraph import cli
from quillgraph.plans import evaluation, extract
from quillgraph.plans.engine import Engine
from quillgraph.sources import files
from quillgraph.sources.store import Store
from quillgraph.streaming import incremental

ORDERS = '''from notifications import notify
import jobs


class Order:
    """An order of a customer."""

    def place(self):
        self.save()
        return notify("placed")

    def save(self):
        jobs.enqueue(self)


def helper():
    def notify():
        pass
    notify()
'''
FILES = {"orders.py": ORDERS, "notifications.py": "def notify(text):\n    send(text)\n\ndef send(text): ...\n", "jobs/__init__.py": "def enqueue(x):\n    return x\n", ".hidden/x.py": "def no(): pass\n", "build/y.py": "def no(): pass\n", "bad.py": "def broken(:\n", "note.txt": "x"}


@pytest.fixture()
def root(tmp_path):
    for name, body in FILES.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(body)
    (tmp_path / "src" / "zero.py").write_bytes(b"x\0y")
    os.symlink(tmp_path / "src" / "orders.py", tmp_path / "src" / "link.py")
    return str(tmp_path / "src")


def edges(e):
    n = e.graph.nodes.select("id", "uid")
    got = e.graph.edges.join(n.withColumnsRenamed({"id": "src", "uid": "a"}), "src").join(n.withColumnsRenamed({"id": "dst", "uid": "b"}), "dst")
    return {(r.a, r.b, r.relation, r.confidence) for r in got.collect()}


def test_walk(spark, root):
    assert {r.path for r in files.read(spark, root).collect()} == {"orders.py", "notifications.py", "jobs/__init__.py", "bad.py"}


def test_index_change_delete(spark, root, tmp_path):
    with Engine(spark, str(tmp_path / "store"), dim=64) as e:
        r = e.index(root)
        assert (r.files_seen, r.files_indexed, r.files_deleted) == (4, 4, 0) and r.embedded == e.graph.nodes.count()
        want = {
            ("orders.py::Order.place", "orders.py::Order.save", "CALLS", 0.92), ("orders.py::Order.place", "notifications.py::notify", "CALLS", 0.97),
            ("orders.py::Order.save", "jobs/__init__.py::enqueue", "CALLS", 0.95), ("notifications.py::notify", "notifications.py::send", "CALLS", 1.0),
        }
        assert edges(e) == want
        assert e.status()["dirty"] == 0
        assert e.index(root).files_indexed == 0
        # a target's file changes: the edge from the other file comes back
        with open(f"{root}/notifications.py", "a") as f:
            f.write("\ndef more():\n    send(1)\n")
        r = e.index(root, embed=False)
        assert r.files_indexed == 1 and r.files_skipped == 3
        assert edges(e) == want | {("notifications.py::more", "notifications.py::send", "CALLS", 1.0)}
        assert "orders.py::Order.place" in {x.uid for x in e.graph.nodes.where("embed_dirty").collect()}
        os.remove(f"{root}/notifications.py")
        assert e.index(root).files_deleted == 1
        assert edges(e) == {x for x in want if "notifications" not in x[0] + x[1]}
        assert [x["src_uid"] for x in e.locate("save")] == ["orders.py::Order.place"]
        assert e.ask("where is save used", as_context=True).uids == ["orders.py::Order.place"]
        assert e.context("how does an order get placed", budget_tokens=300).used_tokens <= 300
    with pytest.raises(RuntimeError):
        e.graph  # noqa: B018


def test_extractor_details():
    rows = extract.extract("p/m.py", b"from . import q\nfrom .r import *\nfrom ... import far\nclass A(B): pass\nclass A(q.C):\n    @staticmethod\n    def f(x):\n        x()\n        g()\n        q.h()\ndef f(): ...\n")
    node = {r["uid"]: r for r in rows if r["what"] == "node"}
    assert set(node) == {"p/m.py::A", "p/m.py::A#1", "p/m.py::A.f", "p/m.py::f"} and node["p/m.py::A.f"]["type"] == "method" and node["p/m.py::f"]["type"] == "function"
    edge = {(r["uid"], r["dst_uid"], r["confidence"]) for r in rows if r["what"] == "edge"}
    assert edge == {("p/m.py::A", "p/r.py::B", 0.5), ("p/m.py::A#1", "p/q.py::C", 0.95), ("p/m.py::A.f", "p/r.py::g", 0.5), ("p/m.py::A.f", "p/q.py::h", 0.95)}
    assert extract.extract("x.py", b"(" * 5000) == [] and extract.extract("x.py", b"") == []
    assert json.loads(node["p/m.py::A"]["attrs"])["start_line"] == 4


def test_snapshots(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.load().nodes.count() == 0
    s.set_meta("k", 1)
    assert Store(spark, str(tmp_path / "s")).get_meta("k") == 1
    with open(tmp_path / "s" / "CURRENT", "w") as f:
        json.dump({"version": 99, "snapshot": None, "meta": {}}, f)
    with pytest.raises(RuntimeError):
        Store(spark, str(tmp_path / "s"))


def test_evaluation_and_cli(spark, root, tmp_path, capsys):
    store = str(tmp_path / "store")
    assert cli.main(["--store", store, "index", root]) == 0
    cases = tmp_path / "cases.jsonl"
    cases.write_text("\n".join(json.dumps(c) for c in [
        {"query": "send", "intent": "LOCATE", "expected_uids": ["notifications.py::notify"]},
        {"query": "how is an order saved", "intent": "EXPLAIN", "expected_uids": ["orders.py::Order.save"]},
        {"query": "gone", "intent": "LOCATE", "expected_uids": ["nowhere"]},
    ]))
    with Engine(spark, store) as e:
        card = evaluation.run(e, evaluation.read_cases(str(cases)))
    assert card.locate["f1"] == 1.0 and card.locate["precision_high"] == 1.0 and card.explain["recall_at_k"] == 1.0 and card.broken == ["gone"]
    assert evaluation.compare(card, evaluation.Scorecard.from_dict(card.to_dict()))["locate"]["f1"] == 0
    with pytest.raises(ValueError):
        evaluation.Scorecard.from_dict({"x": 1})
    assert cli.main(["--store", store, "locate", "notify", "--json"]) == 0
    assert "orders.py::Order.place" in capsys.readouterr().out
    assert cli.main(["--store", store, "query", "who calls save", "--context"]) == 0 and cli.main(["--store", store, "status"]) == 0
    assert cli.main(["nonsense"]) == 1 and cli.main(["--store", store, "index", str(tmp_path / "none")]) == 2


def test_stream_of_edges(spark, root, tmp_path):
    with Engine(spark, str(tmp_path / "store"), dim=16) as e:
        e.index(root)
    store = Store(spark, str(tmp_path / "store"))
    inbox = str(tmp_path / "in")
    up = lambda *rows: spark.createDataFrame(rows, incremental.EDGE_UPDATES).coalesce(1).write.mode("append").parquet(inbox)
    up(("orders.py::helper", "notifications.py::send", "CALLS", 1.0, 0.4, "s", 0))
    stream = spark.readStream.schema(incremental.EDGE_UPDATES).parquet(inbox)
    q = incremental.edge_stream(stream, store, str(tmp_path / "check"))
    q.processAllAvailable()
    up(("orders.py::helper", "notifications.py::send", "CALLS", 2.0, 0.8, "t", 1), ("orders.py::helper", "none", "CALLS", 2.0, 0.8, "t", 2))
    q.processAllAvailable()
    q.stop()
    r = store.load().edges.where("source = 't'").collect()
    assert [(x.weight, x.confidence) for x in r] == [(2.0, 0.8)]
    before = store.state()["snapshot"]
    incremental.merge_edges(store, spark.createDataFrame([], incremental.EDGE_UPDATES), 0)
    assert store.state()["snapshot"] == before
