import duckdb

from quillgraph.llm import decontaminate
from quillgraph.llm.common import table


def both(spark, docs, bench, **kw):
    got = sorted(tuple(r) for r in decontaminate.contaminated(docs, bench, **kw).collect())
    con = duckdb.connect()
    con.register("d", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    con.register("b", bench.select("item_id", "text").toPandas().astype({"item_id": "Int64"}))
    con.execute("create view documents as select * from d; create view benchmark as select * from b")
    return got, sorted(con.execute(decontaminate.sql(**kw)).fetchall())


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got, want = both(spark, table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    assert got == want and len(got) > 10


def test_lower_share_and_long_shingles_equal_sql(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    for kw in ({"share": 0.3}, {"k": 2, "share": 0.5}, {"k": 60, "share": 1.0}):
        got, want = both(spark, docs, bench, **kw)
        assert got == want


def test_windows_ties_and_odd_rows(spark, odd, none):
    item = " ".join(f"i{k}" for k in range(20))
    half = " ".join(f"i{k}" for k in range(10))
    more = spark.createDataFrame([(20, f"x y {item} z {item}"), (21, half + " filler " * 30 + " ".join(f"i{k}" for k in range(10, 20))), (22, item.upper().replace(" ", " ** ")), (None, item), (23, "short one"), (24, "a short. ONE b")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").where("length(text) < 1000 or text is null").union(more)  # SQL takes quadratic time for long texts
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, ""), (None, "short one"), (5, item), (1, item)], "item_id long, text string")
    got, want = both(spark, docs, bench)
    assert got == want
    assert {(r[0], r[1]) for r in got} == {(20, 1), (20, 5), (22, 1), (22, 5), (23, 2), (24, 2)}
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(odd, bench).count() == 0
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_blocks_of_the_benchmark_give_the_same(spark, sf, monkeypatch):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    whole = sorted(decontaminate.contaminated(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK", 300)
    assert sorted(decontaminate.contaminated(docs, bench).collect()) == whole


def test_every_text_of_an_item_is_searched(spark):
    text = lambda x, n=30: " ".join(f"{x}{k}" for k in range(n))
    bench = spark.createDataFrame([(7, text("a")), (7, text("b")), (8, text("c", 60)), (8, text("d", 9)), (8, None), (9, text("e")), (9, text("e")), (9, text("e", 10))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + text("a")), (2, text("b") + " y"), (3, text("c", 60)), (4, "z z " + text("d", 9)), (5, text("a", 15) + " " + text("b", 15)), (6, text("e", 12)), (7, "q " + text("e"))], "doc_id long, text string")
    got, want = both(spark, docs, bench)
    assert got == want
    assert {(r[0], r[1]) for r in got} == {(1, 7), (2, 7), (3, 8), (4, 8), (6, 9), (7, 9)}
    assert next(r[2:] for r in got if r[0] == 7) == (26, 26, 1.0, 1)
