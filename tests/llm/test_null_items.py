"""Benchmark items without an id count as hits and are not named."""

from sinoflow.llm import decontaminate


def test_null_item(spark):
    docs = spark.createDataFrame([(1, "x a b c y"), (2, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c")], "item_id long, text string")
    got = sorted((r["doc_id"], r["n_hit"], r["items"]) for r in decontaminate.contamination(docs, bench).collect())
    assert got == [(1, 3, []), (2, 0, [])]
    assert [r["doc_id"] for r in decontaminate.clean_documents(docs, bench).collect()] == [2]


def test_null_item_as_sql(spark):
    import duckdb

    from sinoflow.llm import queries

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM (VALUES (1, 'x a b c y'), (2, 'clean'), (3, 'a b c d e')) AS t(doc_id, text)")
    con.execute("CREATE VIEW benchmark AS SELECT * FROM (VALUES (NULL, 'a b c'), (5, 'd e')) AS t(item_id, text)")
    rows = sorted(con.execute(f"SELECT doc_id, n_words, n_hit, n_items, contaminated FROM ({queries.ORACLE_SQL['op2_decontaminate']})").fetchall())
    assert rows == [(1, 5, 3, 0, True), (2, 1, 0, 0, False), (3, 5, 5, 1, True)]
