"""An optional layout of the chunk table for approximate search: chunks in cells around centres.

The centres are fitted on a bounded sample; every chunk with a usable vector lies in the cell of
its nearest centre, and cells are partitions of the Parquet files. A search ranks the chunks of the
cells nearest to the query exactly, so that pruning of partitions does the work. Chunks without a
usable vector are in no cell, as no search finds them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import vector as V
from codelode.operators.search import HIT_COLUMNS, filtered, top_k

#: Vectors the centres are fitted on, and centres there may be; both reach the driver.
SAMPLE, MOST_CELLS = 20_000, 4_096
#: Cells searched per query.
PROBES = 16


def centres_of(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means: unit centres of unit vectors; a centre that loses all its vectors stays."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


def build(chunks: DataFrame, path: str, dim: int, cells: int | None = None) -> int:
    """Writes the layout below ``path``; returns the number of cells (by default the square root of the rows).

    Ranges of (cell, id) are written by a task each: a task has few cells, and a cell of any share of
    the rows is written by many tasks. An empty table gives no cell.
    """
    usable = chunks.where(V.searchable(F.col("embedding"), dim))
    n = usable.count()
    if not n:
        return 0
    cells = max(1, min(MOST_CELLS, cells or int(n**0.5)))
    share = min(1.0, 1.2 * SAMPLE / n)
    some = usable.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else usable
    rows = some.select(F.col("embedding").cast("array<double>").alias("v")).limit(SAMPLE).toArrow()
    x = np.asarray(rows.column("v").combine_chunks().flatten()).reshape(-1, dim)
    centres = centres_of(x / np.linalg.norm(x, axis=1, keepdims=True), cells)
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast(centres)  # at most MOST_CELLS vectors

    @F.pandas_udf("int")
    def cell(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = shared.value.T
        for v in vectors:
            yield pd.Series(np.argmax(np.stack(v.to_numpy()).astype(np.float64) @ c, axis=1) if len(v) else [], dtype="int32")

    laid = usable.withColumn("cell", cell("embedding"))
    laid.repartitionByRange("cell", F.xxhash64("id")).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return len(centres)


def search_cells(spark: SparkSession, path: str, query: Sequence[float], k: int = 10, probes: int = PROBES, min_score: float | None = None, columns: Sequence[str] = HIT_COLUMNS, **filters: str | None) -> DataFrame:
    """The best of the ``probes`` cells nearest to the query, with exact scores; all cells give the exact result."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").limit(MOST_CELLS).collect()
    centres = np.array([r["v"] for r in rows])
    q = np.asarray(query, dtype=np.float64)
    near = np.argsort(-(centres @ q), kind="stable")[:probes] if len(q) == centres.shape[1] else []
    table = spark.read.parquet(f"{path}/cells").where(F.col("cell").isin([int(rows[j]["cell"]) for j in near]) if len(near) else F.lit(False))
    return top_k(filtered(table, **filters), query, k, min_score, columns)
