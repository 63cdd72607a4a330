"""Packing token sequences into containers of fixed capacity, with certified lower bounds.

Every partition is packed by best-fit decreasing, and a lower bound from dual feasible functions
is computed for it. A partition that needs no more containers than its bound is certified: only
its emptiest container is left open. In one that is not, every container with a gap is. While the
corpus is above its own bound, open containers give their documents up; these are exchanged
between fewer, mixed partitions and packed again, until the bound is reached, a round gains
nothing, one partition is left, or the given number of rounds is over. Only numbers (id, piece,
size) move; texts never leave the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm import tokens
from codelode.session import cut_lineage

CAPACITY = 2048
#: Items that one task packs at a time; bounds memory, not the result's completeness.
GROUP_ITEMS = 20_000
#: A container counts as full when at most this share of it is unused.
TOLERANCE = 0.005
ROUNDS = 6

SCHEMA = "id bigint, piece_no int, n int, container string, open boolean, certified boolean"


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The best of several dual-feasible-function bounds on the number of containers.

    Functions used: the identity (volume bound), the threshold functions that round items above
    ``capacity - t`` up to a whole container and drop those below ``t``, and the staircase
    functions with ``k`` steps. Sizes must lie in 1..capacity.
    """
    if not len(sizes):
        return 0
    sizes = np.asarray(sizes, dtype=np.int64)
    counts = np.asarray(counts, dtype=np.int64)
    best = -(-int((sizes * counts).sum()) // capacity)
    for t in np.unique(sizes[sizes <= capacity // 2]):
        kept = np.where(sizes > capacity - t, capacity, np.where(sizes >= t, sizes, 0))
        best = max(best, -(-int((kept * counts).sum()) // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        value = np.where(whole, sizes * k, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container number per item, and the used space per container.

    The containers are kept by remaining space; one integer with a bit per space that occurs
    finds the tightest one that still fits.
    """
    order = np.argsort(-sizes, kind="stable")
    where = np.empty(len(sizes), dtype=np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, n = 0, 0
    for i in order.tolist():
        s = int(sizes[i])
        fits = bits >> s
        if fits:
            space = s + ((fits & -fits).bit_length() - 1)
            c = by_space[space].pop()
            if not by_space[space]:
                bits ^= 1 << space
        else:
            space, c = capacity, n
            n += 1
        where[i] = c
        left = space - s
        if left:
            by_space[left].append(c)
            bits |= 1 << left
    return where, np.bincount(where, weights=sizes, minlength=n).astype(np.int64)


def _pack_group(pdf: pd.DataFrame, name: str, capacity: int, tolerance: float, final: bool) -> pd.DataFrame:
    sizes = pdf["n"].to_numpy(dtype=np.int64)
    where, used = best_fit_decreasing(sizes, capacity)
    certified = len(used) == lower_bound(*np.unique(sizes, return_counts=True), capacity)
    loose = capacity - used > tolerance * capacity
    if certified:
        # as few containers as these items allow; together with those of others the emptiest may go
        loose &= (np.arange(len(used)) == np.argmin(used)) & (not final)
    return pdf.assign(container=[f"{name}-{c}" for c in where.tolist()], open=loose[where], certified=certified)


def _pack_in_place(df: DataFrame, rnd: int, capacity: int, group_items: int, tolerance: float, final: bool) -> DataFrame:
    """Packs within each partition of ``df``, in groups of at most ``group_items``; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[pd.DataFrame] = []
        rows = k = 0
        for pdf in batches:
            while len(pdf):
                take = pdf.iloc[: group_items - rows]
                pdf = pdf.iloc[group_items - rows :]
                held.append(take)
                rows += len(take)
                if rows == group_items:
                    yield _pack_group(pd.concat(held, ignore_index=True), f"r{rnd}p{part}g{k}", capacity, tolerance, final)
                    held, rows, k = [], 0, k + 1
        if rows:
            yield _pack_group(pd.concat(held, ignore_index=True), f"r{rnd}p{part}g{k}", capacity, tolerance, final)

    return df.select("id", "piece_no", "n").mapInPandas(run, SCHEMA)


def size_histogram(items: DataFrame, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and how often they occur; at most ``capacity`` rows reach the driver, whatever the corpus."""
    rows = items.where(F.col("n").between(1, capacity)).groupBy("n").count().collect()
    return np.array([r["n"] for r in rows], dtype=np.int64), np.array([r["count"] for r in rows], dtype=np.int64)


def items_of(counts: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``(id, piece_no, n)``: one item per text, or per piece where a text exceeds the capacity."""
    n = F.col("n_tokens")
    return counts.where(n > 0).select(
        F.col(id_col).cast("bigint").alias("id"),
        F.posexplode(
            F.when(n <= capacity, F.array(n)).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.expr(f"cast((n_tokens - 1) div {capacity} as int)")),
                    lambda k: F.least(F.lit(capacity), n - k * capacity),
                )
            )
        ).alias("piece_no", "n"),
    )


def pack_items(items: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, group_items: int = GROUP_ITEMS, tolerance: float = TOLERANCE) -> tuple[DataFrame, dict]:
    """Containers for ``(id, piece_no, n)`` and ``{containers, lower_bound, rounds, certified, partitions, certified_partitions}``.

    ``certified`` says that no packing needs fewer containers; the counts of partitions are sums
    over the rounds.

    Items without tokens are left out; items above the capacity must have been cut. Repeated rows
    are packed once each. An empty input gives an empty frame and a bound of 0.
    """
    items = cut_lineage(items.where(F.col("n") > 0).select(F.col("id").cast("bigint").alias("id"), F.col("piece_no").cast("int").alias("piece_no"), F.col("n").cast("int").alias("n")))
    sizes, counts = size_histogram(items, capacity)
    bound = lower_bound(sizes, counts, capacity)
    whole = items.where(F.col("n") == capacity).select("id", "piece_no", "n", F.concat(F.lit("w"), F.monotonically_increasing_id()).alias("container"))
    # small splits are read together, since larger groups pack better; this moves nothing
    todo = items.where(F.col("n") < capacity).coalesce(max(1, -(-int(counts.sum()) // group_items)))
    done = [whole]
    closed = int(counts[sizes == capacity].sum()) if len(sizes) else 0
    parts = None
    open_bins, last = 0, None
    rnd = n_groups = n_certified = 0
    for rnd in range(1, rounds + 1):
        # a single partition that its own bound certifies is settled for good
        packed = cut_lineage(_pack_in_place(todo, rnd, capacity, group_items, tolerance, parts == 1))
        bins = packed.groupBy("container").agg(F.first("open").alias("open"), F.first("certified").alias("certified"), F.count("*").alias("n"))
        groups = bins.groupBy(F.substring_index("container", "-", 1).alias("g"), "open").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.first("certified").alias("certified"))
        # a handful of figures per round
        per = groups.groupBy("open").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
        told = groups.groupBy("g").agg(F.first("certified").alias("x")).agg(F.count("*").alias("a"), F.count(F.when(F.col("x"), 1)).alias("b")).collect()[0]
        n_groups, n_certified = n_groups + told["a"], n_certified + told["b"]
        state = {r["open"]: (r["c"], r["n"]) for r in per}
        now = state.get(False, (0, 0))[0] + state.get(True, (0, 0))[0]
        if last is not None and now >= open_bins:
            break  # the exchange gained nothing: the containers before it stay
        closed += state.get(False, (0, 0))[0]
        open_bins, open_items = state.get(True, (0, 0))
        done.append(packed.where(~F.col("open")).select("id", "piece_no", "n", "container"))
        last = packed.where("open").select("id", "piece_no", "n", "container")
        if not open_items or closed + open_bins == bound or parts == 1 or rnd == rounds:
            break
        parts = max(1, -(-open_items // group_items))
        # the container is part of the key, so that a repeated id cannot fill one partition
        mix = F.pmod(F.xxhash64("id", "piece_no", "container", F.lit(rnd)), F.lit(parts)).cast("int")
        todo = last.withColumn("__m", mix).repartition(parts, "__m").sortWithinPartitions("n", "id", "piece_no")
    if last is not None:
        done.append(last)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    total = closed + open_bins
    return out, {"containers": total, "lower_bound": bound, "rounds": rnd, "certified": total == bound, "partitions": n_groups, "certified_partitions": n_certified}


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str = tokens.VOCABULARY, **options) -> tuple[DataFrame, dict]:
    """``(id, piece_no, start_token, n_tokens, container)`` for every text with tokens, and the certificate.

    A text is cut only if it alone exceeds the capacity: into whole containers and one rest that
    is packed with the others. Null, empty and untokenisable texts need no container.
    """
    items = items_of(tokens.token_counts(df, id_col, text_col, path), id_col, capacity)
    out, info = pack_items(items, capacity, **options)
    return out.select(F.col("id").alias(id_col), "piece_no", (F.col("piece_no") * capacity).alias("start_token"), F.col("n").alias("n_tokens"), "container"), info
