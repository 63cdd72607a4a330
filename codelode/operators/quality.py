"""Retrieval quality: text-search baselines, score means, context reduction."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.functions import text as X
from codelode.operators.embed import Provider, embed
from codelode.operators.search import batch_search
from codelode.session import spread


#: Distinct words of a query set that one automaton holds, and rows of (query, word) that are broadcast.
MOST_WORDS, MOST_PAIRS = 100_000, 1_000_000


def _words(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(X.query_words(F.col("query_text"))).alias("word"))


def _word_list(queries: DataFrame) -> list[str]:
    """Distinct words of the stated query set; its size is checked."""
    words = [r["word"] for r in _words(queries).select("word").distinct().limit(MOST_WORDS + 1).collect()]
    if len(words) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} distinct query words: run the queries in parts")
    return sorted(words)


def _by_query(found: DataFrame, queries: DataFrame) -> DataFrame:
    """``found`` joined with the queries that have its ``word``; broadcast only up to a checked number of rows."""
    words = _words(queries)
    small = words.limit(MOST_PAIRS + 1).count() <= MOST_PAIRS
    return found.join(F.broadcast(words) if small else words, "word")


def word_counts(chunks: DataFrame, words: list[str], lower: bool, counts: bool) -> tuple[DataFrame, DataFrame]:
    """Per file: ``(file_path, n)`` characters, and ``(file_path, word, c)`` of the words it holds.

    One automaton of all words passes over each text once, so the work is that of the text, not
    of the text times the words. Occurrences of a word don't overlap. Sums are made per file
    within a batch of rows before anything is shuffled. Without ``counts``, ``c`` says only that the word occurs.
    """
    schema = "file_path string, word string, c bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for k, w in enumerate(words):
            auto.add_word(w, k)
        auto.make_automaton()
        size = [len(w) for w in words]
        for batch in batches:
            chars: Counter = Counter()
            held: Counter = Counter()
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    chars[path] += 0
                    continue
                chars[path] += len(text)
                if not counts:
                    for k in {k for _, k in auto.iter(text)}:
                        held[path, k] = 1
                    continue
                last: dict[int, int] = {}
                for end, k in auto.iter(text.lower() if lower else text):
                    if end - size[k] >= last.get(k, -1):
                        last[k] = end
                        held[path, k] += 1
            rows = [(p, None, n) for p, n in chars.items()] + [(p, words[k], c) for (p, k), c in held.items()]
            if rows:
                p, w, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(w, pa.string()), pa.array(c, pa.int64())], names=["file_path", "word", "c"])

    src = spread(chunks.select("file_path", "content"))
    if not words:
        found = src.select("file_path", F.lit(None).cast("string").alias("word"), F.coalesce(F.length("content"), F.lit(0)).cast("bigint").alias("c"))
    else:
        found = src.mapInArrow(run, schema)
    # characters and words go through one shuffle, and come out of one scan
    total = found.groupBy("file_path", "word").agg(F.sum("c").alias("c"))
    return total.where("word is null").select("file_path", F.col("c").alias("n")), total.where("word is not null")


def _tokens(sizes: DataFrame) -> DataFrame:
    return sizes.select("file_path", F.floor(F.col("n") / 4).cast("bigint").alias("tokens"))


def grep_naive(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, n_files, n_tokens)``: all files that hold any word of the query, as written.

    Tokens are a quarter of a file's characters, rounded down per file.
    """
    sizes, has = word_counts(chunks, _word_list(queries), lower=False, counts=False)
    hit = _by_query(has, queries).select("query_id", "file_path").distinct()
    out = hit.join(_tokens(sizes), "file_path").groupBy("query_id").agg(F.count("*").alias("n_files"), F.sum("tokens").alias("n_tokens"))
    return queries.select("query_id").join(out, "query_id", "left").na.fill(0)


def grep_smart(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, file_path, hits, tokens)``: the ``k`` files with most occurrences of the query's words, in lower case."""
    sizes, has = word_counts(chunks, _word_list(queries), lower=True, counts=True)
    hits = _by_query(has, queries).groupBy("query_id", "file_path").agg(F.sum("c").alias("hits"))
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "file_path")
    best = hits.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return best.join(_tokens(sizes), "file_path").select("query_id", "file_path", "hits", "tokens")


def grep_regex(files: DataFrame, words: Sequence[str], path_col: str = "file_path", text_col: str = "content") -> DataFrame:
    """``(path, n_rows, n_chars)`` of the files of which some row matches any of the words, as regular expressions and case-sensitive."""
    return files.where(X.any_of(F.col(text_col), words)).groupBy(path_col).agg(F.count("*").alias("n_rows"), F.sum(F.length(text_col)).cast("bigint").alias("n_chars"))


def run_models(chunks: DataFrame, queries: DataFrame, models: dict[str, Callable[[], Provider]], k: int = 10) -> DataFrame:
    """``(model, query_id, rank, chunk_id, score, tokens)``: every query against every chunk, with every model.

    Texts are embedded by each provider; a chunk that one can't embed has no rank with it.
    """
    out = None
    for name, make in models.items():  # models are a handful; each is one embedding pass and one search
        dim = make().dim
        c = embed(spread(chunks.select("id", "content")), make).select("id", "embedding")
        q = embed(queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("query_text").alias("content")), make).select("query_id", "embedding")
        hits = batch_search(c, q, k, dim=dim).select(F.lit(name).alias("model"), "query_id", "rank", "chunk_id", "score")
        out = hits if out is None else out.unionByName(hits)
    size = chunks.select(F.col("id").alias("chunk_id"), X.approx_tokens(F.col("content")).alias("tokens"))
    return out.join(size, "chunk_id").select("model", "query_id", "rank", "chunk_id", "score", "tokens")


def write_json(results: DataFrame, path: str) -> None:
    """The result document: one JSON object per model and query, with its hits in order."""
    hit = F.struct("rank", "chunk_id", "score", "tokens")
    doc = results.groupBy("model", "query_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"), F.sum("tokens").alias("tokens"))
    doc.withColumn("written_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("overwrite").json(path)


def clean_results(results: DataFrame) -> DataFrame:
    """Result rows that count: repeated ones once, without null or NaN scores."""
    cols = ["run_id", "model", "query_id", "rank", "chunk_id", "score", "tokens"]
    return results.select(*cols).where(F.col("score").isNotNull() & ~F.isnan("score")).distinct()


def top_means(results: DataFrame) -> DataFrame:
    """``(model, n_runs, top1, top3, top5)``: means over runs of the mean of the first scores.

    Scores are rounded to 4 digits first; a run with fewer than three (five) hits counts 0 there.
    """
    per = clean_results(results).withColumn("s", F.round("score", 4)).groupBy("model", "run_id")
    mean = lambda n: F.when(F.count(F.when(F.col("rank") <= n, 1)) >= n, F.avg(F.when(F.col("rank") <= n, F.col("s")))).otherwise(0.0)
    runs = per.agg(mean(1).alias("t1"), mean(3).alias("t3"), mean(5).alias("t5"))
    return runs.groupBy("model").agg(F.count("*").alias("n_runs"), F.round(F.avg("t1"), 6).alias("top1"), F.round(F.avg("t3"), 6).alias("top3"), F.round(F.avg("t5"), 6).alias("top5"))


def context_reduction(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """``(model, avg_tokens, baseline_tokens, reduction)``: how much less context than a baseline; 0 where undefined."""
    runs = clean_results(results).groupBy("model", "run_id").agg(F.sum("tokens").alias("t"))
    model = runs.groupBy("model").agg(F.avg("t").alias("avg_tokens"))
    base = baseline.agg(F.avg("n_tokens").alias("baseline_tokens"))
    ratio = F.coalesce(F.try_divide("baseline_tokens", "avg_tokens"), F.lit(0.0))
    # one row of figures beside a row per model
    return model.join(F.broadcast(base), F.lit(True)).select("model", F.round("avg_tokens", 4).alias("avg_tokens"), F.round("baseline_tokens", 4).alias("baseline_tokens"), F.round(ratio, 4).alias("reduction"))


def hits_with_chunks(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(run_id, rank, chunk_id, file_path, symbol, score)`` of hits whose chunk exists."""
    c = chunks.select(F.col("id").alias("chunk_id"), "file_path", "symbol")
    return clean_results(results).join(c, "chunk_id").select("run_id", "rank", "chunk_id", "file_path", "symbol", F.round("score", 4).alias("score"))
