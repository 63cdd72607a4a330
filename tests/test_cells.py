import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.operators import cells, search
from codelode.session import table

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are missing")
def test_recall_and_layout(spark, tmp_path):
    c = table(spark, DATA, "code_chunks")
    path = str(tmp_path / "layout")
    n = cells.build(c, path, 64)
    laid = spark.read.parquet(f"{path}/cells")
    usable = c.where(search.V.searchable(F.col("embedding"), 64))
    assert 40 <= n <= 60 and laid.count() == usable.count() and laid.select("id").exceptAll(usable.select("id")).isEmpty()
    queries = [(r["id"], [float(x) for x in r["embedding"]]) for r in usable.where("id % 500 = 0").select("id", "embedding").collect()]
    hit = total = 0
    for _, q in queries:
        exact = {r["id"] for r in search.semantic_search(c, q, min_score=None).collect()}
        found = cells.search_cells(spark, path, q)
        hit += len(exact & {r["id"] for r in found.collect()})
        total += len(exact)
    assert total >= 50 and hit / total >= 0.9
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    q = queries[0][1]
    everywhere = [tuple(r) for r in cells.search_cells(spark, path, q, probes=n, language="python").collect()]
    assert everywhere == [tuple(r) for r in search.semantic_search(c, q, language="python", min_score=None).collect()]
    assert cells.search_cells(spark, path, [0.0] * 64).count() == 0 and cells.search_cells(spark, path, [1.0]).count() == 0


def test_nothing_and_a_hot_cell(spark, tmp_path):
    df = spark.createDataFrame([(k, f"/f{k}", [1.0, 0.0] if k % 3 else [float(k % 7), 1.0]) for k in range(300)] + [(900, "/x", None), (901, "/y", [0.0, 0.0])], "id bigint, file_path string, embedding array<float>")
    assert cells.build(df.where("false"), str(tmp_path / "none"), 2) == 0
    assert cells.build(df, str(tmp_path / "a"), 2, 4) == 4
    got = cells.search_cells(spark, str(tmp_path / "a"), [1.0, 0.0], 5, probes=1, columns=["id"]).collect()
    assert [r["id"] for r in got] == [1, 2, 4, 5, 7]
    assert np.allclose(np.linalg.norm(cells.centres_of(np.eye(3), 2), axis=1), 1)
