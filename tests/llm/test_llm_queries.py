import os

import duckdb
import pytest

from codelode.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are missing")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in queries.ORACLE_SQL:
        c = duckdb.connect()
        for f in os.listdir(DATA):
            c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
        rel = c.sql(queries.ORACLE_SQL[name])
        cols = list(rel.columns)
        assert sorted(tuple(r[c] for c in cols) for r in rows) == sorted(rel.fetchall())
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


def test_columns_of_the_found_queries(spark):
    want = {"p1_found": ["file_path"], "p2_found": ["id"], "p3_found": ["id", "line_no"], "p4_found": ["id", "function_name"], "p5_found": ["id_a", "id_b"], "p6_found": ["file_path"], "p7_found": ["id_a", "id_b"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"]}
    assert {n: queries.QUERIES[n](spark, DATA).columns for n in want} == want
