"""Near-duplicate texts by probability MinHash, banding and exact verification.

Every text becomes the set (or multiset) of its word shingles. ProbMinHash lets each shingle
arrive as a Poisson process with its weight as the rate; registers keep the earliest arrival, and
a text stops drawing as soon as no later arrival can win. Equal registers estimate the
probability Jaccard similarity (for equal weights: the Jaccard similarity). Bands of registers
propose pairs, the shingle sets decide them.

Texts with equal shingle sets form one class from the start, so a group of copies of any size
costs one node. Buckets stream through sorted partitions; those above ``bucket_limit`` nodes are not
paired up but split by the other buckets of their nodes, and where even that leaves a large one,
an exact prefix-filter join takes over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode.session import cut_lineage, spread

WORD = re.compile(r"[A-Za-z0-9_]+")
WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 3
#: Bands in which a pair must meet to be verified. At similarity 0.6 a pair meets in 8.6 of 40 bands
#: on average and in fewer than two with a probability of 0.0007; at 0.2, in two or more with 0.04.
MATCHES = 2
#: Nodes of a bucket that are paired up directly; larger buckets take the exact prefix join.
BUCKET_LIMIT = 64
#: Groups of equal texts up to this size are written out pair by pair; larger ones as links to their smallest id.
EXPAND = 64
#: Rows of a class that one task pairs up with as many; larger classes are split into blocks of this size.
BLOCK = 1024

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64); wraps around by design."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit word hashes, kept for words seen before; forgets everything when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h


def shingle_sets(texts: list[str | None], k: int, words: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count), sorted, one row per distinct shingle of a text.

    A word is a longest run of ASCII letters, digits and ``_``. Texts with fewer than ``k`` words
    (null and empty ones too) have no shingle.
    """
    hashes, sizes = [], []
    get = words.__getitem__
    for t in texts:
        w = WORD.findall(t) if t else []
        sizes.append(max(0, len(w) - k + 1))
        if len(w) >= k:
            hashes.append(np.fromiter(map(get, w), dtype=np.uint64, count=len(w)))
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = []
    with np.errstate(over="ignore"):
        for h in hashes:
            n = len(h) - k + 1
            s = np.zeros(n, dtype=np.uint64)
            for i in range(k):
                s = mix(s * _GOLD + h[i : i + n])
            out.append(s)
    flat = np.concatenate(out)
    doc = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((flat, doc))
    flat, doc = flat[order], doc[order]
    first = np.ones(len(flat), dtype=bool)
    first[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return doc[at], flat[at], np.diff(np.append(at, len(flat)))


def prob_minhash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures ``(n_docs, m)`` of weighted item sets; rows of texts without items stay 0.

    The arrivals of an item depend on the item alone: the t-th waiting time is exponential with
    the item's weight as the rate, and falls on a register drawn uniformly. An item is dropped as
    soon as its next arrival lies behind the last register's earliest arrival.
    """
    best = np.full(n_docs * m, np.inf)
    sig = np.zeros(n_docs * m, dtype=np.uint64)
    h = np.zeros(len(item))
    doc, item, rate = doc.astype(np.int64), item.copy(), 1.0 / weight.astype(np.float64)
    t = 0
    with np.errstate(over="ignore"):
        while len(item):
            a = mix(item + np.uint64(2 * t + 1) * _GOLD)
            b = mix(item + np.uint64(2 * t + 2) * _GOLD)
            h = h - np.log1p(-((a >> np.uint64(11)).astype(np.float64) * 2.0**-53)) * rate
            flat = doc * m + (b % np.uint64(m)).astype(np.int64)
            wins = h < best[flat]
            at, when, what = flat[wins], h[wins], item[wins]
            order = np.argsort(-when, kind="stable")  # of several arrivals at a register the earliest is written last
            best[at[order]] = when[order]
            sig[at[order]] = what[order]
            alive = h < best.reshape(n_docs, m).max(axis=1)[doc]
            doc, item, rate, h = doc[alive], item[alive], rate[alive], h[alive]
            t += 1
    return sig.reshape(n_docs, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per text and band."""
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, (len(sig), bands)).copy()
        parts = sig.reshape(len(sig), bands, rows)
        for r in range(rows):
            key = mix(key * _M2 + parts[:, :, r])
    return key


def _list_array(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def signatures(df: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """``(id, cls, n, content, keys)``: class (hash of the shingle set), set size, hash of the text, and band keys.

    The keys of a class come out once per task; its other rows have null keys. Texts without a
    shingle are left out: they are similar to nothing.
    """
    src = spread(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")))
    schema = "id bigint, cls bigint, n int, content bigint, keys array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = WordHash(), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                texts = batch.column(1).to_pylist()
                doc, item, count = shingle_sets(texts, words, cache)
                n = np.bincount(doc, minlength=len(texts))
                have = np.flatnonzero(n)
                if not len(have):
                    continue
                with np.errstate(over="ignore"):
                    part = mix(item + (count.astype(np.uint64) * _GOLD if weighted else np.uint64(0)))
                    ends = np.cumsum(n[have])
                    total = np.add.reduceat(part, np.append(0, ends[:-1]))
                    cls = mix(total ^ (n[have].astype(np.uint64) * _GOLD)).view(np.int64)
                fresh = np.zeros(len(texts), dtype=bool)
                for k, c in zip(have.tolist(), cls.tolist(), strict=True):
                    if c not in seen:
                        seen.add(c)
                        fresh[k] = True
                use = fresh[doc]
                number = np.cumsum(fresh) - 1
                sig = prob_minhash(number[doc[use]], item[use], count[use] if weighted else np.ones(int(use.sum())), int(fresh.sum()), bands * rows)
                keys = band_keys(sig, bands, rows).view(np.int64).reshape(-1)
                sizes = np.where(fresh[have], bands, 0)
                lists = _list_array(keys, sizes, pa.int64())
                content = np.array([xxhash.xxh3_64_intdigest(texts[k].encode("utf-8", "surrogatepass")) for k in have.tolist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(have)), pa.array(cls), pa.array(n[have].astype(np.int32)), pa.array(content), lists], names=["id", "cls", "n", "content", "keys"])

    return src.mapInArrow(run, schema)


def _pairs_of_runs(similarity: float, limit: int, whole: bool):
    """Streams rows sorted by (key, cls): pairs of small buckets; the nodes of large ones one by one.

    Unless all rows of a key are here (``whole``), the first and the last bucket of the stream may
    go on elsewhere: their rows come out as ``(edge, key, cls, n)``, one null class standing for
    more rows than a small bucket has.
    """
    names = ["big", "edge", "a", "b"]

    def emit(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key0, nodes, large, last, first_key = None, [], False, None, None  # the bucket that may go on in the next batch

        def close(edge: bool) -> None:
            if key0 is None:
                return
            if edge and not whole:
                out.extend([(None, key0, None, 0)] if large else [(None, key0, c, k) for c, k in nodes])
            elif not large:
                for x in range(len(nodes)):
                    for y in range(x + 1, len(nodes)):
                        (ca, na), (cb, nb) = nodes[x], nodes[y]
                        if min(na, nb) >= similarity * max(na, nb):
                            out.append((None, None, min(ca, cb), max(ca, cb)))

        def grow() -> None:
            """The bucket is a large one from here on."""
            nonlocal large, nodes
            large = True
            out.extend((key0, None, c, k) for c, k in nodes)
            nodes = []

        for batch in batches:
            key, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            if not len(key):
                continue
            marked = batch.column(1).null_count > 0
            cls = batch.column(1).to_pylist() if marked else batch.column(1).to_numpy()
            change = np.ones(len(key), dtype=bool)
            change[1:] = key[1:] != key[:-1]
            starts = np.flatnonzero(change)
            sizes = np.diff(np.append(starts, len(key)))
            # single-row buckets within the batch need no work
            inner = (sizes > 1) | (np.arange(len(starts)) == len(starts) - 1) | (np.arange(len(starts)) == 0)
            for s, size in zip(starts[inner].tolist(), sizes[inner].tolist(), strict=True):
                k = int(key[s])
                if k != key0:
                    close(key0 == first_key)
                    first_key = k if first_key is None else first_key
                    key0, nodes, large, last = k, [], False, None
                for j in range(s, s + size):
                    if cls[j] is None:
                        if not large:
                            grow()
                        continue
                    c = int(cls[j])
                    if c == last:
                        continue
                    last = c
                    if large:
                        out.append((key0, None, c, int(n[j])))
                        continue
                    nodes.append((c, int(n[j])))
                    if len(nodes) > limit:
                        grow()
            if out:
                yield emit(out)
                out.clear()
        close(True)
        if out:
            yield emit(out)

    return run


def _meetings(keyed: DataFrame, similarity: float, limit: int) -> DataFrame:
    """``(big, a, b)``: pairs of classes that share a small bucket, or (key, class, size) of large ones.

    Rows are split by ranges of (key, class), so that one key of any share of the rows is spread
    over tasks; buckets cut by a range's end, at most two of ``limit`` rows a task, are put together again.
    """
    schema = "big bigint, edge bigint, a bigint, b bigint"
    runs = keyed.select("key", "cls", F.col("n").cast("bigint").alias("n")).repartitionByRange(F.col("key"), F.col("cls")).sortWithinPartitions("key", "cls")
    met = cut_lineage(runs.mapInArrow(_pairs_of_runs(similarity, limit, False), schema))
    edges = met.where("edge is not null").select(F.col("edge").alias("key"), F.col("a").alias("cls"), F.col("b").alias("n"))
    # the null class, if there is one, comes first
    rest = edges.repartition(F.col("key")).sortWithinPartitions("key", F.asc_nulls_first("cls")).mapInArrow(_pairs_of_runs(similarity, limit, True), schema)
    return met.where("edge is null").unionByName(rest).select("big", "a", "b")


def _sets_of(df: DataFrame, members: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``(cls, items, counts)`` of the wanted classes, from the text of one member each."""
    wanted = members.groupBy("cls").agg(F.min("id").alias("id")).join(nodes, "cls", "left_semi")
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).join(wanted, "id").select("cls", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            doc, item, count = shingle_sets(texts, words, cache)
            n = np.bincount(doc, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), _list_array(item.view(np.int64), n, pa.int64()), _list_array(count.astype(np.int32), n, pa.int32())], names=["cls", "items", "counts"])

    # repeated rows of one id give the class twice
    return src.mapInArrow(run, "cls bigint, items array<bigint>, counts array<int>").dropDuplicates(["cls"])


def _similarity(weighted: bool):
    """Similarity of two joined sets ``x_items``, ``y_items``."""
    if not weighted:
        both = F.size(F.array_intersect("x_items", "y_items"))
        return both / (F.size("x_items") + F.size("y_items") - both)
    schema = T.DoubleType()

    @F.pandas_udf(schema)
    def prob(xi, xc, yi, yc):
        import pandas as pd

        return pd.Series([probability_jaccard(*z) for z in zip(xi, xc, yi, yc, strict=True)], dtype="float64")

    return prob("x_items", "x_counts", "y_items", "y_counts")


def probability_jaccard(items_x, counts_x, items_y, counts_y) -> float:
    """Exact probability Jaccard similarity of two weighted sets, given as distinct items and their weights.

    The sum over shared items of ``1 / sum_j max(x_j / x_i, y_j / y_i)``. By rising ``y / x`` the
    inner sums are prefix sums of y's and x's weights, so the work is that of a sort.
    """
    items, at = np.unique(np.concatenate([items_x, items_y]), return_inverse=True)
    w = np.zeros((2, len(items)))
    np.add.at(w[0], at[: len(items_x)], np.asarray(counts_x, dtype=np.float64))
    np.add.at(w[1], at[len(items_x) :], np.asarray(counts_y, dtype=np.float64))
    with np.errstate(divide="ignore"):
        order = np.argsort(w[1] / w[0], kind="stable")
    x, y = w[:, order]
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    inner = np.cumsum(x)[both] / x[both] + (y.sum() - np.cumsum(y))[both] / y[both]
    return float((1.0 / inner).sum())


def _large_bucket_pairs(big: DataFrame, sets: DataFrame, similarity: float, weighted: bool, block: int) -> DataFrame:
    """Exact candidates among the nodes of large buckets by a prefix filter on rare shingles.

    No similarity exceeds the share that the shared shingles have of either text's weight. So if
    two texts reach ``similarity``, and each keeps the first of its shingles in one common order
    until those left weigh less than that share, they keep one in common: else all shared ones
    would be among those left of the text whose kept part ends first. By rising frequency the kept
    parts meet rarely; a shingle that more than ``block`` texts keep is met block by block.
    """
    nodes = big.select(F.col("a").alias("cls")).distinct()
    weight = F.col("e.count") if weighted else F.lit(1)
    items = sets.join(nodes, "cls", "left_semi").select("cls", F.size("items").alias("n"), F.explode(F.arrays_zip(F.col("items").alias("item"), F.col("counts").alias("count"))).alias("e")).select("cls", "n", F.col("e.item").alias("item"), weight.cast("double").alias("w"))
    df = items.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    ranked = items.join(df, "item", "left").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "item", "w"))).alias("order"), F.sum("w").alias("all"))
    # kept as long as a shingle and those behind it weigh enough; the fold stops counting where they don't
    enough = F.lit(similarity - 1e-9) * F.col("all")
    count = F.aggregate("order", F.struct(F.col("all").alias("rest"), F.lit(0).alias("k")), lambda a, e: F.struct((a["rest"] - e["w"]).alias("rest"), (a["k"] + F.when(a["rest"] >= enough, 1).otherwise(0)).alias("k")), lambda a: a["k"])
    prefix = ranked.select("cls", "n", F.explode(F.slice("order", F.lit(1), count)).alias("o")).where("o.df > 0").select("cls", "n", F.col("o.item").alias("item"))
    # a shingle kept by many is split: each text meets its own block and those of higher number
    often = prefix.groupBy("item").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    prefix = prefix.join(often.where("blocks > 1"), "item", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    x = prefix.select("item", F.col("cls").alias("cx"), F.col("n").alias("nx"), F.col("block").alias("bx"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("by"))
    y = prefix.select("item", F.col("cls").alias("cy"), F.col("n").alias("ny"), F.col("block").alias("by"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("bx"))
    ok = F.col("cx") != F.col("cy") if weighted else (F.col("cx") != F.col("cy")) & (F.least("nx", "ny") >= F.lit(similarity) * F.greatest("nx", "ny"))
    met = x.join(y, ["item", "bx", "by"]).where(ok & (F.expr("bx < by") | F.expr("cx < cy")))
    return met.select(F.least("cx", "cy").alias("a"), F.greatest("cx", "cy").alias("b")).distinct()


def near_duplicate_classes(
    df: DataFrame,
    id_col: str = "id",
    text_col: str = "content",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    weighted: bool = False,
    bucket_limit: int = BUCKET_LIMIT,
    matches: int = MATCHES,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """``members (id, cls, n, content)`` and ``links (a, b, similarity)`` between different classes.

    A class holds the rows of equal shingle sets. ``links`` has each pair of classes of at least
    the given similarity once, with ``a < b``; similarity is exact. Rows without a shingle (null,
    empty or shorter texts) belong to no class. Repeated ids count once. An empty table gives two
    empty frames.
    """
    sig = cut_lineage(signatures(df, id_col, text_col, words, bands, rows, weighted))
    members = sig.select("id", "cls", "n", "content")
    keyed = sig.where(F.size("keys") > 0).select(F.explode("keys").alias("key"), "cls", "n")
    low = similarity if not weighted else 0.0  # sizes say nothing about weights
    met = _meetings(keyed, low, bucket_limit)
    once = met.where("big is null").groupBy("a", "b").agg(F.count("*").alias("c"))
    crowd = met.where("big is not null").select("big", F.col("a").alias("cls"), F.col("b").cast("int").alias("n"))
    pairs = once.where(F.col("c") >= matches).select("a", "b")
    big = None
    if not crowd.isEmpty():
        # the second meeting of a pair may have been in a large bucket: once in a small one will do then
        crowded = crowd.select("cls").distinct()
        half = once.where(F.col("c") < matches).select("a", "b")
        half = half.join(crowded.withColumnRenamed("cls", "a"), "a", "left_semi").join(crowded.withColumnRenamed("cls", "b"), "b", "left_semi").select("a", "b")
        # or all its meetings were in large ones: buckets of two large buckets each are far smaller
        own = crowd.groupBy("cls", "n").agg(F.array_sort(F.collect_set("big")).alias("ks")).where(F.size("ks") > 1)
        two = own.select("cls", "n", F.posexplode("ks").alias("i", "k"), "ks").select("cls", "n", "k", F.explode(F.slice("ks", F.col("i") + 2, F.size("ks"))).alias("k2"))
        again = _meetings(two.select(F.xxhash64("k", "k2").alias("key"), "cls", "n"), low, bucket_limit)
        pairs = pairs.union(half).union(again.where("big is null").select("a", "b")).distinct()
        big = again.where("big is not null").select("a")
        if big.isEmpty():
            big = None
    pairs = cut_lineage(pairs)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("cls"))
    if big is not None:
        nodes = nodes.union(big.withColumnRenamed("a", "cls"))
    sets = _sets_of(df, members, nodes.distinct(), id_col, text_col, words)
    if big is not None:
        sets = cut_lineage(sets)
        pairs = pairs.union(_large_bucket_pairs(big, sets, similarity, weighted, block)).distinct()
    xs = sets.select(F.col("cls").alias("a"), F.col("items").alias("x_items"), F.col("counts").alias("x_counts"))
    ys = sets.select(F.col("cls").alias("b"), F.col("items").alias("y_items"), F.col("counts").alias("y_counts"))
    links = pairs.join(xs, "a").join(ys, "b").select("a", "b", _similarity(weighted).alias("similarity")).where(F.col("similarity") >= similarity)
    return members, links


def near_duplicate_pairs(members: DataFrame, links: DataFrame, expand: int | None = EXPAND, block: int = BLOCK) -> DataFrame:
    """``(id_a, id_b, similarity)`` of rows, with ``id_a < id_b``.

    All pairs of different texts are written out, within a class and across links, whatever the
    size of the class. Equal texts are, too, in groups of up to ``expand`` rows (of any size if it
    is None); a larger group is written as links of its members to its smallest id. Classes above
    ``block`` rows are paired up block by block.
    """
    m = members.groupBy("id", "cls").agg(F.min("content").alias("content"))
    sizes = m.groupBy("cls").agg(F.count("*").alias("c")).withColumn("blocks", F.ceil(F.col("c") / block).cast("int"))
    many = m.join(sizes.where("c > 1"), "cls").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    texts = many.groupBy("cls", "content").agg(F.count("*").alias("copies"), F.min("id").alias("rep"))
    if expand is not None:
        large = texts.where(F.col("copies") > expand)
        many = many.join(large.select("cls", "content", F.lit(True).alias("large")), ["cls", "content"], "left")
    else:
        many = many.withColumn("large", F.lit(None).cast("boolean"))
    # each row meets its own block and those of higher number
    x = many.select("cls", F.col("id").alias("ix"), F.col("content").alias("cx"), "large", F.col("block").alias("bx"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("by"))
    y = many.select("cls", F.col("id").alias("iy"), F.col("content").alias("cy"), F.col("block").alias("y"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("bx")).withColumnRenamed("y", "by")
    met = x.join(y, ["cls", "bx", "by"]).where("(bx < by or ix < iy) and (large is null or cx <> cy)")
    within = met.select(F.least("ix", "iy").alias("id_a"), F.greatest("ix", "iy").alias("id_b"), F.lit(1.0).alias("similarity"))
    if expand is not None:
        star = m.join(large.select("cls", "content", "rep"), ["cls", "content"]).where("id > rep")
        within = within.union(star.select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("similarity")))
    ends = m.join(sizes, "cls").select("cls", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    blocks = sizes.select("cls", "blocks")
    across = (
        links.join(blocks.select(F.col("cls").alias("a"), F.col("blocks").alias("na")), "a")
        .join(blocks.select(F.col("cls").alias("b"), F.col("blocks").alias("nb")), "b")
        .select("a", "b", "similarity", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("ba"), "nb")
        .select("a", "b", "similarity", "ba", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bb"))
        .join(ends.select(F.col("cls").alias("a"), F.col("block").alias("ba"), F.col("id").alias("ia")), ["a", "ba"])
        .join(ends.select(F.col("cls").alias("b"), F.col("block").alias("bb"), F.col("id").alias("ib")), ["b", "bb"])
        .select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), "similarity")
    )
    return within.union(across)


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, root)`` of every node of ``(a, b)`` links, by alternating large and small stars.

    Each round is two shuffles on the links and a cut of the lineage; the number of rounds grows
    with the logarithm of the longest chain. No link reaches the driver. Links that ``max_rounds``
    don't settle are an error, not a partial result.
    """
    e = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        new = small.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new = cut_lineage(new)
        same = new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty()
        e = new
        if same:
            break
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per row id: ``(id, cls, group_id, n_links)``.

    ``cls`` is the class of equal shingle sets, ``group_id`` the smallest id of the connected
    group, ``n_links`` the number of other classes the row's class is linked to.
    """
    links = cut_lineage(links.select("a", "b"))
    root = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    m = members.select("id", "cls").distinct().join(root.withColumnRenamed("node", "cls"), "cls", "left").join(degree, "cls", "left")
    m = m.withColumn("root", F.coalesce("root", "cls"))
    first = m.groupBy("root").agg(F.min("id").alias("group_id"))
    return m.join(first, "root").select("id", "cls", "group_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
