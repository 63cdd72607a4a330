"""Retrieval: filtered exact cosine top-k for one query or many, file context, statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.functions import text as X
from codelode.functions import vector as V
from codelode.session import cut_lineage

HIT_COLUMNS = ("id", "file_path", "language", "symbol", "start_line", "end_line")
#: The longest result to which texts are fetched.
MOST_HITS = 1000
#: Query vectors that are broadcast for one scan of the chunks (at 64 values, 32 MB), and those multiplied at a time.
QUERY_PASS, QUERY_BLOCK = 65_536, 4096
#: From so many chunks of one file on, their places in it are counted over all tasks.
LARGE_FILE = 10_000


def filtered(chunks: DataFrame, language: str | None = None, file_pattern: str | None = None, repo_path: str | None = None) -> DataFrame:
    """The conjunction of the filters that are set; an empty string sets none."""
    if language:
        chunks = chunks.where(F.col("language") == language)
    if file_pattern:
        chunks = chunks.where(X.postgres_like(F.col("file_path"), file_pattern))
    if repo_path:
        chunks = chunks.where(X.under(F.col("file_path"), repo_path))
    return chunks


def top_k(chunks: DataFrame, query: Sequence[float], k: int, min_score: float | None, columns: Sequence[str] = HIT_COLUMNS) -> DataFrame:
    """The ``k`` best of ``chunks``: scanned once, with one bounded heap per task."""
    spark = chunks.sparkSession
    if not len(query) or not any(query) or k <= 0:
        return spark.createDataFrame([], chunks.select(*columns).schema).withColumn("score", F.lit(None).cast("double"))
    q = V.vector(query)
    length = float(np.linalg.norm(np.asarray(query, dtype=np.float64)))
    score = V.cosine_similarity(F.col("embedding"), q, F.lit(length))
    hits = chunks.where(V.searchable(F.col("embedding"), len(query))).select(*columns, score.alias("__s"))
    # equal to filtering after the limit, as the order is exact
    if min_score is not None:
        hits = hits.where(F.col("__s") >= min_score)
    return hits.orderBy(F.round("__s", 9).desc(), "id").limit(k).select(*columns, F.round("__s", 4).alias("score"))


def semantic_search(chunks: DataFrame, query: Sequence[float], top_k_: int = 10, language: str | None = None, file_pattern: str | None = None, repo_path: str | None = None, min_score: float | None = 0.3) -> DataFrame:
    """Hits of one query vector, best first; ties by id. A zero or empty query finds nothing."""
    return top_k(filtered(chunks, language, file_pattern, repo_path), query, top_k_, min_score)


def with_details(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with ``content``, ``summary`` and ``metadata``, best first.

    The ranking reads narrow columns only, once. Its rows come to the driver, at most ``MOST_HITS``
    of them, and texts are read from the row groups that hold their ids. ``hits`` are rows of ``chunks``.
    """
    rows = hits.limit(MOST_HITS + 1).collect()
    if len(rows) > MOST_HITS:
        raise ValueError(f"more than {MOST_HITS} hits: join them with the chunks instead")
    ids = [r["id"] for r in rows]
    more = chunks.where(F.col("id").isin(ids) if ids else F.lit(False)).select("id", "content", "summary", "metadata")
    best = hits.sparkSession.createDataFrame(rows, hits.schema)
    return more.join(F.broadcast(best), "id").select(*hits.columns, "content", "summary", "metadata").orderBy(F.desc("score"), "id")


def related_chunks(chunks: DataFrame, query: Sequence[float], file_path: str, k: int = 5) -> DataFrame:
    """The best chunks of other files, in all repositories and languages, with no threshold."""
    return top_k(chunks.where(F.col("file_path") != file_path), query, k, None)


def file_chunks(chunks: DataFrame, file_path: str) -> DataFrame:
    """The chunks of one file in order; those without a line last."""
    return chunks.where(F.col("file_path") == file_path).orderBy(F.asc_nulls_last("start_line"), "id").select(*HIT_COLUMNS)


def numbered(df: DataFrame, order: Sequence[Column], large: int = LARGE_FILE) -> DataFrame:
    """``df`` with ``position``, from 1, in an order.

    Up to ``large`` rows are counted in one task. More are sorted by ranges over all tasks; one
    number per range reaches the driver, the rows of the ranges before it.
    """
    if df.limit(large + 1).count() <= large:
        return df.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    # the places of rows in their partitions hold only for what is written down
    parts = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    sizes = {r["p"]: r["n"] for r in parts.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    before, at = [], 0
    for p in range(max(sizes) + 1):
        before.append(at)
        at += sizes.get(p, 0)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    starts = F.array(*[F.lit(x).cast("bigint") for x in before])
    return parts.withColumn("position", (F.element_at(starts, F.spark_partition_id() + 1) + place + 1).cast("int"))


def file_context(chunks: DataFrame, file_path: str, focus: Sequence[float] | None = None, k: int = 5) -> DataFrame:
    """``(kind, position, id, ...)``: the file's chunks and, with a focus, the related ones."""
    own = numbered(chunks.where(F.col("file_path") == file_path).select(*HIT_COLUMNS), [F.asc_nulls_last("start_line"), F.asc("id")])
    out = own.select(F.lit("chunk").alias("kind"), "position", *HIT_COLUMNS, F.lit(None).cast("double").alias("score"))
    if focus is None:
        return out
    near = related_chunks(chunks, focus, file_path, k)
    w2 = Window.orderBy(F.col("score").desc(), "id")  # k rows
    return out.unionByName(near.select(F.lit("related").alias("kind"), F.row_number().over(w2).alias("position"), *HIT_COLUMNS, "score"))


def stats(chunks: DataFrame, repo_path: str | None = None, approximate: bool = False) -> DataFrame:
    """One row: chunks, distinct files, distinct languages; nulls are no language."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    src = filtered(chunks, repo_path=repo_path)
    return src.agg(F.count("*").alias("total_chunks"), distinct("file_path").alias("total_files"), distinct("language").alias("total_languages"))


def batch_search(chunks: DataFrame, queries: DataFrame, k: int = 10, dim: int = 64, block: int = QUERY_BLOCK, per_pass: int = QUERY_PASS) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: exact top-k of many query vectors ``(query_id, embedding)``.

    One scan of the chunks answers up to ``per_pass`` queries. Each task multiplies its rows with
    one block of them after the other and keeps ``k`` rows per query, so the shuffle is at most
    ``k`` rows per query and task. Queries and chunks without a direction have no part. A chunk
    finds itself if it is among the queries.
    """
    spark = chunks.sparkSession
    usable_q = queries.where(V.searchable(F.col("embedding"), dim)).select("query_id", F.col("embedding").cast("array<float>").alias("v"))
    src = chunks.where(V.searchable(F.col("embedding"), dim)).select("id", F.col("embedding").cast("array<float>").alias("v"))
    n = usable_q.count()
    out = None
    size = max(1, -(-n // per_pass))
    for part in range(size):
        mine = usable_q if size == 1 else usable_q.where(F.pmod(F.xxhash64("query_id"), F.lit(size)) == part)
        rows = mine.toArrow()
        ids = rows.column("query_id").to_numpy()
        q = np.asarray(rows.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim) if len(ids) else np.zeros((0, dim))
        q = q / np.linalg.norm(q, axis=1, keepdims=True) if len(ids) else q
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, qv = shared.value
            # per block: query number, score, chunk of what is kept, and each query's k-th best score
            best = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)) for _ in range(0, len(qids), block)]
            least = np.full((len(qids), 1), -np.inf)
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    b = batch.slice(lo, 2048)
                    cid = b.column(0).to_numpy()
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                    for j, q0 in enumerate(range(0, len(qids), block)):
                        s = np.round(qv[q0 : q0 + block] @ x, 9)
                        # after a few batches hardly anything reaches a query's k-th best; ties do
                        r, c = np.nonzero(s >= least[q0 : q0 + block])
                        if not len(r):
                            continue
                        n, v, i = (np.concatenate(z) for z in zip(best[j], (r + q0, s[r, c], cid[c]), strict=True))
                        order = np.lexsort((i, -v, n))
                        n, v, i = n[order], v[order], i[order]
                        rank = np.arange(len(n)) - np.searchsorted(n, n)
                        keep = rank < k
                        least[n[rank == k - 1], 0] = v[rank == k - 1]
                        best[j] = (n[keep], v[keep], i[keep])
            for n, v, i in best:
                if len(n):
                    yield pa.RecordBatch.from_arrays([pa.array(qids[n]), pa.array(i), pa.array(v)], names=["query_id", "chunk_id", "score"])

        found = src.mapInArrow(run, "query_id bigint, chunk_id bigint, score double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


def rendered(hits: DataFrame, content: Column, n: int = 25) -> DataFrame:
    """Hits with a text to print: a head line and the first lines of the content."""
    head = F.format_string("%s:%s-%s %s (%.3f)", "file_path", F.coalesce(F.col("start_line").cast("string"), F.lit("?")), F.coalesce(F.col("end_line").cast("string"), F.lit("?")), F.coalesce("symbol", F.lit("")), F.coalesce("score", F.lit(0.0)))
    return hits.withColumn("rendered", F.concat_ws("\n", head, X.preview(content, n)["rendered"]))


def merge_latest(chunks: DataFrame, keys: Sequence[str] = ("file_path", "symbol", "start_line"), newest: str | None = None) -> DataFrame:
    """Upsert by natural key: of rows with equal keys (nulls equal too) the latest stays.

    Rows with the highest value in ``newest``, if it is given, count as later than all others.
    """
    first = [F.desc(newest)] if newest else []
    w = Window.partitionBy(*keys).orderBy(*first, F.desc_nulls_last("created_at"), F.desc("id"))
    return chunks.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
