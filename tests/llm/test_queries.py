import os

import duckdb
import pytest

from quern.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_queries_run_and_equal_their_sql(spark, data, name):
    df = q.queries()[name](spark, data)
    got = [tuple(x) for x in df.collect()]
    sql = q.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
    assert sorted(got) == sorted(want)


def test_found_columns_are_those_asked_for(spark, data):
    want = {"p1": ["finding_key_a", "finding_key_b"], "p2": ["file_id"], "p3": ["finding_key"], "p4": ["file_id"], "p5": ["file_id"], "p6": ["file_id", "line_no"], "p7": ["doc_id", "item_id"], "p8": ["source"], "p9": ["doc_id"]}
    assert {k[:2]: f(spark, data).columns for k, f in q.queries().items() if k.endswith("_found")} == want
