"""The most similar vectors for every vector, from robust-pruned directed graphs per shard.

Vectors are routed to cells by a coarse quantiser; a cell is cut into shards of bounded size.
Each shard gets a directed graph: points are inserted in batches, a greedy beam search proposes
their neighbours, and relaxed distance pruning keeps the diverse edges. Every vector then beam
searches the shards of the cells nearest to it, and the best of all shards count.

Only the quantiser is fitted on a bounded sample (``SAMPLE`` vectors); every vector is indexed
and every vector is a query. Equal vectors enter a graph once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.session import cut_lineage

#: The quantiser is fitted on at most so many vectors; this bounds what reaches the driver.
SAMPLE = 20_000
#: A cell has about so many vectors; above twice that it is cut into several shards.
CELL = 3_000
MAX_CELLS = 4_096
#: Cells searched per query, those whose centre is nearly as near as the nearest one.
PROBES, PROBE_MARGIN = 4, 0.2
DEGREE, BEAM, ALPHA, EXPAND = 20, 28, 1.2, 8
BATCH = 512


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Graph:
    """A directed neighbour graph over unit vectors; similarity is the inner product."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        self.n, self.degree, self.beam, self.alpha = len(x), degree, beam, alpha
        self.slots = degree + degree // 2  # reverse edges may overfill a list up to here before it is pruned
        self.adj = np.full((self.n, self.slots), -1, dtype=np.int32)
        self.deg = np.zeros(self.n, dtype=np.int32)
        if self.n:
            self.entry = int(np.argmax(self.x @ self.x.mean(axis=0)))
            self._build(np.random.default_rng(seed))

    def _build(self, rng) -> None:
        order = rng.permutation(self.n)
        order = np.concatenate([[self.entry], order[order != self.entry]])
        # the first points link among themselves exactly, later batches search what is there
        first = order[: min(self.n, 64)]
        self._link(first, np.tile(first, (len(first), 1)))
        at, size = len(first), 64
        while at < self.n:
            batch = order[at : at + size]
            found, _ = self.search(self.x[batch], self.beam)
            self._link(batch, found)
            at += size
            size = min(BATCH, size * 2)

    def _prune(self, points: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Robust pruning of candidate lists (-1: none) to at most ``degree`` diverse neighbours."""
        valid = (cand >= 0) & (cand != points[:, None])
        c = np.where(valid, cand, 0)
        v = self.x[c]
        sim = np.einsum("bcd,bd->bc", v, self.x[points])
        dist = np.where(valid, 1.0 - sim, np.inf).astype(np.float32)
        order = np.argsort(dist, axis=1, kind="stable")
        dist = np.take_along_axis(dist, order, 1)
        c = np.take_along_axis(c, order, 1)
        v = np.take_along_axis(v, order[:, :, None], 1)
        between = 1.0 - np.matmul(v, v.transpose(0, 2, 1))
        alive = np.isfinite(dist)
        # a candidate that occurs twice is its own neighbour at distance 0
        count = np.zeros(len(points), dtype=np.int32)
        out = np.full((len(points), self.degree), -1, dtype=np.int32)
        for i in range(c.shape[1]):
            take = np.flatnonzero(alive[:, i] & (count < self.degree))
            if not len(take):
                continue
            out[take, count[take]] = c[take, i]
            count[take] += 1
            alive[take] &= self.alpha * between[take, i] > dist[take]
        return out

    def _link(self, points: np.ndarray, cand: np.ndarray) -> None:
        keep = self._prune(points, np.concatenate([cand.astype(np.int32), self.adj[points]], axis=1))
        self.adj[points] = -1
        self.adj[points, : self.degree] = keep
        self.deg[points] = (keep >= 0).sum(axis=1)
        src = np.repeat(points, self.degree)
        dst = keep.reshape(-1)
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, start, size = np.unique(dst, return_index=True, return_counts=True)
        rank = np.arange(len(dst)) - np.repeat(start, size)
        pos = self.deg[dst] + rank
        fits = pos < self.slots
        self.adj[dst[fits], pos[fits]] = src[fits]
        self.deg[nodes] = np.minimum(self.deg[nodes] + size, self.slots)
        full = nodes[(self.deg[nodes] >= self.slots)]
        if len(full):
            extra = np.full((len(full), self.slots), -1, dtype=np.int32)
            slot = np.full(self.n, -1, dtype=np.int64)
            slot[full] = np.arange(len(full))
            over = ~fits & (pos - self.slots < self.slots)
            extra[slot[dst[over]], (pos[over] - self.slots)] = src[over]
            for lo in range(0, len(full), BATCH):
                part = full[lo : lo + BATCH]
                kept = self._prune(part, np.concatenate([self.adj[part], extra[lo : lo + BATCH]], axis=1))
                self.adj[part] = -1
                self.adj[part, : self.degree] = kept
                self.deg[part] = (kept >= 0).sum(axis=1)

    def search(self, q: np.ndarray, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of many queries in step: ``(ids, similarities)``, best first; -1 fills up."""
        beam = beam or self.beam
        b = len(q)
        q = q.astype(np.float32)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, self.n + 1), dtype=bool)
        seen[:, self.n] = True
        ids = np.full((b, beam), self.n, dtype=np.int32)
        sim = np.full((b, beam), -np.inf, dtype=np.float32)
        todo = np.zeros((b, beam), dtype=bool)
        ids[:, 0] = self.entry
        sim[:, 0] = q @ self.x[self.entry]
        todo[:, 0] = True
        seen[:, self.entry] = True
        active = np.arange(b)
        while len(active):
            t, s, i = todo[active], sim[active], ids[active]
            r = rows[: len(active)]
            # the best unexpanded entries; rows are sorted, so the first ones
            rank = np.cumsum(t, axis=1)
            chosen = t & (rank <= EXPAND)
            cols = np.argsort(~chosen, axis=1, kind="stable")[:, :EXPAND]
            picked = np.take_along_axis(chosen, cols, 1)
            node = np.where(picked, np.take_along_axis(i, cols, 1), -1)
            t &= ~chosen
            new = np.where((node >= 0)[:, :, None], self.adj[node], -1).reshape(len(active), -1)
            new = np.where(new < 0, self.n, new)
            known = seen[active[:, None], new]
            new = np.where(known, self.n, new)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = self.n
            width = int((new < self.n).sum(axis=1).max(initial=0))
            if width:
                new.sort(axis=1)
                new = new[:, :width]
                seen[active[:, None], new] = True
                have = new < self.n
                vs = np.einsum("bcd,bd->bc", self.x[np.where(have, new, 0)], q[active])
                vs = np.where(have, vs, -np.inf)
                s = np.concatenate([s, vs], axis=1)
                i = np.concatenate([i, new], axis=1)
                t = np.concatenate([t, have], axis=1)
                top = np.argsort(-s, axis=1, kind="stable")[:, :beam]
                s, i, t = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1), np.take_along_axis(t, top, 1)
            sim[active], ids[active], todo[active] = s, i, t
            active = active[t.any(axis=1)]
        return np.where(ids < self.n, ids, -1), sim


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means centres of unit vectors; empty cells keep their start."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), size=min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-12), centres)
    return centres


def usable(vector: Column, dim: int) -> Column:
    """True for vectors of ``dim`` values, none null or NaN, not all zero; never null."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v))
    some = F.exists(vector, lambda v: v != 0)
    return F.coalesce((F.size(vector) == dim) & ~bad & some, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _route(df: DataFrame, centres, dim: int, probes: int, margin: float) -> DataFrame:
    """``(shard, id, role, v)``: role 0 is the row's own shard, role 1 a shard it only queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, per = centres.value
        base = np.concatenate([[0], np.cumsum(per)])
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            vec = _matrix(batch.column(1), dim)
            s = unit(vec) @ c.T
            k = min(probes, s.shape[1])
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            score = np.take_along_axis(s, near, 1)
            order = np.argsort(-score, axis=1)
            near, score = np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)
            wanted = score >= score[:, :1] - margin
            out_row, out_shard, out_role = [], [], []
            own = near[:, 0]
            # a cell of several shards spreads its rows over them by id
            with np.errstate(over="ignore"):
                spread = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            mine = base[own] + spread % per[own]
            out_row.append(np.arange(len(ids)))
            out_shard.append(mine)
            out_role.append(np.zeros(len(ids), dtype=np.int8))
            for j in range(k):
                rows = np.flatnonzero(wanted[:, j])
                cell = near[rows, j]
                rep = per[cell]
                r = np.repeat(rows, rep)
                sh = np.repeat(base[cell], rep) + (np.arange(len(r)) - np.repeat(np.cumsum(rep) - rep, rep))
                use = sh != mine[r]
                out_row.append(r[use])
                out_shard.append(sh[use])
                out_role.append(np.ones(int(use.sum()), dtype=np.int8))
            row = np.concatenate(out_row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_shard).astype(np.int32)), batch.column(0).take(pa.array(row)), pa.array(np.concatenate(out_role)), batch.column(1).take(pa.array(row))],
                names=["shard", "id", "role", "v"],
            )

    return df.mapInArrow(run, "shard int, id bigint, role tinyint, v array<float>")


def _search_shards(routed: DataFrame, dim: int, k: int, min_sim: float, beam: int, degree: int) -> DataFrame:
    """``(id, other, sim)`` of every row of a shard against the shard's graph.

    The partitions are sorted by shard and role, so that a shard's own rows come first: they make
    the graph and are queries too. Queries from elsewhere stream past it in batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "other", "sim"]

        def answer(graph, exact, gids, qids, qvec):
            outs = []
            for lo in range(0, len(qids), BATCH):
                q = unit(qvec[lo : lo + BATCH])
                found, _ = graph.search(q, beam)
                # similarities in double precision decide order and threshold
                s = np.einsum("bcd,bd->bc", exact[np.maximum(found, 0)], q)
                ok = (found >= 0) & (s >= min_sim) & (gids[np.maximum(found, 0)] != qids[lo : lo + BATCH, None])
                order = np.lexsort((np.where(ok, gids[np.maximum(found, 0)], np.iinfo(np.int64).max), np.where(ok, -np.round(s, 12), np.inf)), axis=1)[:, :k]
                sel = np.take_along_axis(ok, order, 1)
                r, c = np.nonzero(sel)
                col = order[r, c]
                outs.append((qids[lo : lo + BATCH][r], gids[found[r, col]], s[r, col]))
            a, b, s = (np.concatenate(x) for x in zip(*outs, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], names=names)

        shard, graph, exact, gids = None, None, None, None
        own_ids, own_vec = [], []

        def build():
            nonlocal graph, exact, gids, own_ids, own_vec
            gids = np.concatenate(own_ids) if own_ids else np.zeros(0, np.int64)
            exact = unit(np.concatenate(own_vec)) if own_ids else np.zeros((0, dim))
            graph = Graph(exact, degree=degree, beam=beam) if len(gids) else None
            own_ids, own_vec = [], []

        for batch in batches:
            if not batch.num_rows:
                continue
            sh, ids, role = (batch.column(j).to_numpy() for j in range(3))
            vec = _matrix(batch.column(3), dim)
            change = np.flatnonzero((sh[1:] != sh[:-1]) | (role[1:] != role[:-1])) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(sh)], strict=True):
                if shard != sh[lo]:
                    if own_ids:
                        build()
                        yield answer(graph, exact, gids, gids, exact)
                    shard, graph = int(sh[lo]), None
                if role[lo] == 0:
                    own_ids.append(ids[lo:hi])
                    own_vec.append(vec[lo:hi])
                else:
                    if own_ids:
                        build()
                        yield answer(graph, exact, gids, gids, exact)
                    if graph is not None:
                        yield answer(graph, exact, gids, ids[lo:hi], vec[lo:hi])
        if own_ids:
            build()
            yield answer(graph, exact, gids, gids, exact)

    return routed.mapInArrow(run, "id bigint, other bigint, sim double")


def nearest_neighbours(
    df: DataFrame,
    id_col: str = "id",
    vector_col: str = "embedding",
    dim: int = 64,
    k: int = 5,
    min_similarity: float = 0.9,
    cell: int = CELL,
    probes: int = PROBES,
    margin: float = PROBE_MARGIN,
    beam: int = BEAM,
    degree: int = DEGREE,
) -> DataFrame:
    """``(id, neighbour_id, similarity, rank)``: up to ``k`` other vectors per usable vector.

    Similarity is the cosine, of at least ``min_similarity``; equal ones rank by smaller id.
    Unusable vectors (null, wrong length, NaN, all zero) take no part. Rows of equal vectors share
    one graph node, and each still gets its own neighbours. Repeated ids count once. Without a
    usable vector the result is empty.
    """
    spark = df.sparkSession
    raw = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(usable(F.col("v"), dim))
    raw = raw.select("id", "v", F.xxhash64("v").alias("h"))
    by_hash = Window.partitionBy("h").orderBy("id")
    # the limit runs before the shuffle too, so a third of all rows under one vector cost k + 1 rows a task
    firsts = raw.select("id", "h", "v").withColumn("rn", F.dense_rank().over(by_hash)).where(F.col("rn") <= k + 1)
    before = F.lag("id").over(by_hash)  # repeated rows of one id lie side by side
    firsts = cut_lineage(firsts.withColumn("before", before).where("before is null or before <> id").drop("before"))
    nodes = firsts.where("rn = 1").select("id", "v")
    n = nodes.count()
    empty = spark.createDataFrame([], "id bigint, neighbour_id bigint, similarity double, rank int")
    if not n:
        return empty
    share = min(1.0, 1.2 * SAMPLE / n)
    # by a hash of the vector, so that a recomputed task gives the same sample
    some = nodes.where(F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else nodes
    sample = unit(_matrix(some.select("v").limit(SAMPLE).toArrow().column("v"), dim))
    cells = max(1, min(MAX_CELLS, len(sample) // 4 or 1, -(-n // cell)))
    centres = fit_centres(sample, cells).astype(np.float64)
    # rows per cell decide how many shards it has; one number per cell reaches the driver
    near = np.argmax(sample @ centres.T, axis=1)
    expected = np.bincount(near, minlength=len(centres)) * (n / len(sample))
    per = np.maximum(1, np.ceil(expected / (2 * cell))).astype(np.int64)
    shared = spark.sparkContext.broadcast((centres, per))  # at most MAX_CELLS x dim doubles
    routed = _route(nodes, shared, dim, probes, margin)
    parts = int(min(per.sum(), max(int(spark.conf.get("spark.sql.shuffle.partitions")), per.sum() // 4)))
    routed = routed.repartition(parts, "shard").sortWithinPartitions("shard", "role")
    found = _search_shards(routed, dim, k + 1, min_similarity, beam, degree)
    # only classes of equal vectors need their other members back
    dup = firsts.where("rn = 2").select("h")
    order = Window.partitionBy("id").orderBy(F.round("sim", 12).desc(), "other")

    def ranked(x: DataFrame) -> DataFrame:
        return x.dropDuplicates(["id", "other"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", F.col("other").alias("neighbour_id"), F.col("sim").alias("similarity"), "rank")

    if dup.isEmpty():
        return ranked(found)
    few = firsts.join(dup, "h", "left_semi").select("h", "id", "rn")
    rep = few.where("rn = 1").select("h", F.col("id").alias("rep"))
    heads = few.join(rep, "h").select("rep", F.col("id").alias("member"))
    found = cut_lineage(found)
    # neighbours: the first members of the neighbour's class
    wide = found.join(heads, found["other"] == heads["rep"], "left").select("id", F.coalesce("member", "other").alias("other"), "sim")
    # queries: every member of the class, with its own class at similarity 1
    every = raw.select("id", "h").distinct().join(rep, "h").select(F.col("id").alias("member"), "rep")
    twin = every.join(heads.withColumnRenamed("member", "other"), "rep").where("member <> other").select(F.col("member").alias("id"), "other", F.lit(1.0).alias("sim"))
    best = wide.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k + 1).drop("rk")
    others = best.join(every, best["id"] == every["rep"], "left").select(F.coalesce("member", best["id"]).alias("id"), "other", "sim")
    return ranked(others.where("id <> other").unionByName(twin))
