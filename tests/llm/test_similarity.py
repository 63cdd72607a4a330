import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.llm import neardup, neighbours


def runs(text, k):
    w = neardup.WORD.findall(text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    vocab = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for _ in range(60):
        base = r.choices(vocab, k=r.randint(20, 120))
        for _ in range(r.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(r.choice([0, 1, 3, 8])):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append((k, " ".join(t)))
            k += 1
    rows += [(900, None), (901, ""), (902, "a b"), (903, "x y z"), (904, "x y z"), (5, rows[5][1])]
    rows += [(1000 + j, "same text for all of these rows") for j in range(70)]  # a hot group of copies
    return rows


@pytest.mark.parametrize("limit,block", [(64, 1024), (2, 1024), (2, 3)])
def test_pairs_equal_brute_force(spark, corpus, limit, block):
    df = spark.createDataFrame(corpus, "id bigint, content string").withColumn("cls", F.lit("clash")).repartition(3)
    members, links = neardup.near_duplicate_classes(df, words=3, similarity=0.6, bucket_limit=limit, block=block)
    got = [(r["id_a"], r["id_b"]) for r in neardup.near_duplicate_pairs(members, links).collect()]
    assert len(got) == len(set(got))
    texts = dict(corpus)
    sets = {i: runs(t, 3) for i, t in texts.items() if runs(t, 3)}
    ids = sorted(i for i in sets if i < 1000)
    want = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    want |= {(1000, 1000 + j) for j in range(1, 70)}  # copies beyond the limit hang on their smallest id
    assert set(got) == want
    full = {(r["id_a"], r["id_b"]) for r in neardup.near_duplicate_pairs(members, links, expand=100).collect()}
    assert len(full - want) == 69 * 70 // 2 - 69
    rows = neardup.near_duplicate_groups(members, links).collect()
    assert len({r["cls"] for r in rows if r["id"] >= 1000}) == 1 and {r["cls"] for r in rows} == {r["cls"] for r in members.collect()}
    groups = {r["id"]: r["group_id"] for r in neardup.near_duplicate_groups(members, links).collect()}
    assert set(groups) == set(sets) and {groups[1000 + j] for j in range(70)} == {1000}
    assert all(groups[a] == groups[b] for a, b in want)


@pytest.mark.parametrize("block", [1024, 16])
def test_large_class_of_different_texts(spark, block):
    rows = [(k, "one two three four five six" + ";" * (k % 50)) for k in range(100)] + [(200, "one two three four five six seven"), (201, "one two three four five six seven")]
    df = spark.createDataFrame(rows, "id bigint, content string")
    members, links = neardup.near_duplicate_classes(df, words=3, similarity=0.6)
    got = [(r["id_a"], r["id_b"]) for r in neardup.near_duplicate_pairs(members, links, block=block).collect()]
    ids = sorted(i for i, _ in rows)
    assert sorted(got) == [(a, b) for a in ids for b in ids if a < b]
    # equal texts beyond the limit hang on their smallest id, or are written out like all others
    df = spark.createDataFrame([(k, "one two three four five six" + ";" * (k == 9)) for k in range(70)], "id bigint, content string")
    members, links = neardup.near_duplicate_classes(df, words=3, similarity=0.6)
    count = lambda expand: neardup.near_duplicate_pairs(members, links, expand=expand, block=block).distinct().count()
    assert count(64) == 68 + 69 and count(None) == 70 * 69 // 2


def test_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "id bigint, content string")
    members, links = neardup.near_duplicate_classes(df)
    assert members.count() == 0 and neardup.near_duplicate_pairs(members, links).count() == 0


def test_registers_estimate_the_probability_jaccard():
    r = np.random.default_rng(3)
    a = {int(x): int(w) for x, w in zip(r.integers(1, 2**60, 80), r.integers(1, 6, 80))}
    b = dict(list(a.items())[:55]) | {int(x): 2 for x in r.integers(1, 2**60, 20)}
    m = 4096
    doc = np.array([0] * len(a) + [1] * len(b))
    item = np.array([*a, *b], dtype=np.uint64)
    sig = neardup.prob_minhash(doc, item, np.array([*a.values(), *b.values()]), 2, m)
    assert abs((sig[0] == sig[1]).mean() - neardup.probability_jaccard([*a], [*a.values()], [*b], [*b.values()])) < 0.04
    doubled = neardup.prob_minhash(np.zeros(len(a), int), np.array([*a], dtype=np.uint64), np.array([*a.values()]) * 2, 1, m)
    assert (doubled[0] == sig[0]).mean() > 0.99  # only proportions count


def test_probability_jaccard_by_its_definition():
    r = random.Random(2)
    for _ in range(50):
        a, b = ({r.randrange(12): r.randint(1, 9) for _ in range(r.randint(1, 8))} for _ in range(2))
        want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {**a, **b}) for i in a if i in b)
        assert abs(neardup.probability_jaccard([*a], [*a.values()], [*b], [*b.values()]) - want) < 1e-12


def test_weighted_pairs_in_large_buckets(spark):
    # one heavy shared shingle among many light ones: the sets are unlike, the weighted texts alike
    rows = [(k, "a b c " * 200 + " ".join(f"t{k}x{j}" for j in range(20))) for k in range(6)] + [(9, "q r s t u v w")]
    df = spark.createDataFrame(rows, "id bigint, content string")
    members, links = neardup.near_duplicate_classes(df, words=3, similarity=0.8, weighted=True, bucket_limit=2)
    assert len(neardup.near_duplicate_pairs(members, links).collect()) == 15


def test_a_key_of_all_rows_is_split(spark):
    hot = spark.range(50_000).select(F.lit(7).cast("bigint").alias("key"), F.col("id").alias("cls"), F.lit(10).alias("n"))
    few = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (3, 5, 10), (9, 5, 10), (9, 6, 3), (9, 7, 9)], "key bigint, cls bigint, n int")
    met = neardup._meetings(hot.union(few), 0.6, 64)
    assert met.where("big = 7").count() == 50_000 and met.where("big = 7").select("a").distinct().count() == 50_000
    assert sorted((r["a"], r["b"]) for r in met.where("big is null").collect()) == [(1, 2), (5, 7)]


def test_components_that_do_not_settle(spark):
    with pytest.raises(RuntimeError):
        neardup.components(spark.createDataFrame([(k, k + 1) for k in range(60)], "a bigint, b bigint"), max_rounds=1)


def test_weighted_shingles(spark):
    rows = [(1, "a b c " * 10 + "d e f g h"), (2, "a b c " * 10 + "d e f g i"), (3, "q r s t u v w")]
    df = spark.createDataFrame(rows, "id bigint, content string")
    members, links = neardup.near_duplicate_classes(df, words=3, similarity=0.5, weighted=True)
    assert [(r["id_a"], r["id_b"]) for r in neardup.near_duplicate_pairs(members, links).collect()] == [(1, 2)]


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (200, 200)]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100}


# ---- neighbours


def clustered(n, dim, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 12, dim))
    return centres[r.integers(0, len(centres), n)] + 0.25 * r.normal(size=(n, dim))


def top(ids, x, k, low):
    u = neighbours.unit(x)
    s = u @ u.T
    out = {}
    for a in range(len(ids)):
        best = sorted((-round(s[a, b], 12), ids[b]) for b in range(len(ids)) if b != a and s[a, b] >= low)[:k]
        out[ids[a]] = [i for _, i in best]
    return out


def test_graph_recall():
    x = neighbours.unit(clustered(1500, 32, 1))
    g = neighbours.Graph(x)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    found, sim = g.search(x)
    hit = sum(len(set(np.argsort(-s[i])[:5]) & set(found[i].tolist())) for i in range(len(x)))
    assert hit / (5 * len(x)) > 0.9 and (np.diff(sim[:, :5], axis=1) <= 1e-6).all()
    assert (g.deg <= g.slots).all() and neighbours.Graph(x[:1]).search(x[:1])[0][0, 0] == 0


def test_recall_against_brute_force(spark):
    x = clustered(3000, 64, 2).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>").withColumn("v", F.lit("clash"))
    want = top(list(range(3000)), x.astype(np.float64), 5, 0.9)
    got = {}
    for r in neighbours.nearest_neighbours(df, cell=400).collect():
        got.setdefault(r["id"], []).append(r["neighbour_id"])
    total = sum(map(len, want.values()))
    assert total > 3000 and sum(len(set(w) & set(got.get(i, []))) for i, w in want.items()) / total >= 0.9


def test_unusable_copies_and_ties(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0]
    rows = [(i, a) for i in range(10)] + [(20, b), (21, b), (30, None), (31, [0.0] * 3), (32, [float("nan")] * 3), (33, [1.0]), (34, [0.0, 0.0, 1.0]), (0, a)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    got = {}
    for r in neighbours.nearest_neighbours(df, dim=3).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour_id"])
    assert got[0] == [1, 2, 3, 4, 5] and got[9] == [0, 1, 2, 3, 4] and got[20] == [21, 0, 1, 2, 3] and got[21] == [20, 0, 1, 2, 3]
    assert set(got) == {*range(10), 20, 21}
    assert neighbours.nearest_neighbours(df.where("id = 30"), dim=3).count() == 0
    assert neighbours.nearest_neighbours(df.where("false"), dim=3).count() == 0
