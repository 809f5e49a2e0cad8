"""The mix on equal rows at the end of a budget, and where its documents go."""

import duckdb
import pytest

from terncube.llm import mixing


def tables(spark):
    rows = [(i % 11, "w " * (i % 5), "b", None, i) for i in range(60)]
    rows += [(7, "a b c", "x", "one", 0)] * 9 + [(None, "p q", "x", None, 0)] * 5 + [(3, None, "x", "none", 0), (4, "", "x", "none", 0)]
    rows += [(100 + i, "k " * (1 + i % 7), "x", "two", 0) for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")


@pytest.mark.parametrize("bucket_rows", [1, 20, 4096])
def test_equal_rows_take_turns_as_in_the_sql(spark, bucket_rows):
    documents = tables(spark)
    got = mixing.mix(documents, bucket_rows=bucket_rows).select("doc_id", "size", "source_size", "target", "taken").collect()
    frame = documents.toPandas()
    con = duckdb.connect()
    con.execute("create table documents as select CAST(doc_id AS BIGINT) AS doc_id, text, source from frame")
    want = con.execute(mixing.mix_sql()).fetchall()
    plain = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert plain(got) == plain(want) and any(0 < r["taken"] % max(r["size"], 1) for r in got)


def test_texts_do_not_move(spark):
    plan = mixing.mix(tables(spark).dropDuplicates(), keep=("text",))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
