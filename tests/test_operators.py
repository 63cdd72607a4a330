import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.operators import chunking, projects, quality, search
from codelode.operators.definitions import definitions
from codelode.operators.embed import HashingProvider, HttpProvider, create_provider, embed
from codelode.plans import samples


def fold(text, lo=100, hi=2000):
    """The same fold as a plain loop."""
    out, st, held = [], 1, []
    ls = text.split("\n")
    for i, line in enumerate(ls, 1):
        held.append(line)
        if len("\n".join(held)) >= hi:
            out.append((st, i, "\n".join(held)))
            st, held = i + 1, []
    if len("\n".join(held)) >= lo:
        out.append((st, len(ls), "\n".join(held)))
    return out


def test_line_fold_equals_the_loop(spark):
    r = random.Random(3)
    texts = ["x", "a" * 99, "a" * 100, "a" * 1999, "a" * 2000, "a" * 5000, "a\n" * 1000, "\n" * 5 + "é" * 150 + "\n"]
    texts += ["\n".join("w" * r.randint(0, 300) for _ in range(r.randint(1, 60))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for row in chunking.chunk_by_lines(df, ["id"], "t").collect():
        got.setdefault(row["id"], []).append((row["start_line"], row["end_line"], row["content"]))
    for k, t in enumerate(texts):
        assert sorted(got.get(k, [])) == (fold(t) if t.strip() else []), k


def test_line_fold_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n ")], "id int, t string")
    assert chunking.chunk_by_lines(df, ["id"], "t").count() == 0


PY = '''"""doc"""
import os

CONST = [
    "%s",
]


@decorated
def first(a):
    """%s"""
    return a


class Big:
    def method(self):
        return "%s"


def tiny():
    pass
''' % ("x" * 120, "y" * 100, "z" * 3000)


def test_definitions():
    got = definitions(PY, "python")
    assert [(g[0], g[4]) for g in got] == [("<module>", "module_level"), ("first", "definition"), ("Big", "definition")]
    assert got[1][1].startswith("@decorated") and len(got[2][1]) > 2000
    assert definitions("x = 1\n", "python") is None
    assert definitions("def a():\n    pass\n", "python") == []


@pytest.mark.parametrize("language", sorted(samples.SOURCES))
def test_definitions_of_the_samples(language):
    got = [x[:1] + x[2:4] for x in definitions(samples.SOURCES[language], language, 1) if x[4] == "definition"]
    assert got == samples.EXPECTED[language]


@pytest.mark.parametrize("language", sorted(samples.SOURCES))
def test_definitions_of_cut_off_files(language):
    text = samples.SOURCES[language]
    for k in range(0, len(text), 7):  # every start of a file gives something, and spans stay in it
        for symbol, content, first, last, _ in definitions(text[:k], language, 1) or []:
            assert symbol and content and 1 <= first <= last <= text[:k].count("\n") + 1


def test_definitions_behind_an_error():
    go = "func A() {\n\tif x {\n}\n\nfunc B() {\n}\n"
    assert [x[0] for x in definitions(go, "go", 1)] == ["A", "B"]
    assert [x[0] for x in definitions("def a(:\n    x = (1,\n\ndef b():\n    pass\n", "python", 1)] == ["a", "b"]
    assert [x[0] for x in definitions("}\nint f(void) {\n  return g(1;\n}\nint h(void) { return 1; }\n", "c", 1)] == ["f", "h"]
    assert definitions("", "go") is None and definitions("}}})", "java") is None


def test_offsets_are_characters():
    got = definitions("x = 'äöü€'\ndef f():\n    return 'é'\n", "python", 1)
    assert got[1][1] == "def f():\n    return 'é'"


def test_chunk_files(spark):
    flat = "x = 1\n" * 50
    rows = [("a.py", "python", PY), ("b.py", "python", flat), ("c.md", "markdown", "# t\r\n" + "word " * 40), ("d.py", "python", "de (:\n" + flat), ("e.x", None, flat), ("f.py", "python", None), ("g.py", "python", "  ")]
    df = spark.createDataFrame(rows, "path string, language string, content string")
    got = {(r["file_path"], r["symbol"], r["kind"]) for r in chunking.chunk_files(df).collect()}
    assert got == {("a.py", "<module>", "module_level"), ("a.py", "first", "definition"), ("a.py", "Big", "definition"), ("b.py", "<block_1>", "line_based"), ("c.md", "<block_1>", "line_based"), ("d.py", "<block_1>", "line_based")}


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, f"/r{i % 3}/f{i % 5}.py", ["python", "go", None][i % 3], f"s{i}", i, i, r.normal(size=4).tolist()) for i in range(40)]
    rows += [(100, "/r0/z.py", "python", "a", 1, 1, [0.0] * 4), (101, "/r0/z.py", "python", "b", 1, 1, [math.nan] * 4), (102, "/r0/z.py", "python", "c", None, 1, [1.0]), (103, "/r0/z.py", "python", "d", 2, 1, None), (104, "/r0/z.py", "python", "e", 1, 1, rows[3][6])]
    return spark.createDataFrame(rows, "id bigint, file_path string, language string, symbol string, start_line int, end_line int, embedding array<float>")


def brute(df, q, keep=lambda r: True):
    out = []
    for r in df.collect():
        v = r["embedding"]
        if v and len(v) == len(q) and not any(math.isnan(x) for x in v) and any(v) and keep(r):
            out.append((-round(float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)), 9), r["id"]))
    return [i for _, i in sorted(out)]


def test_semantic_search(spark, vectors):
    q = [float(x) for x in vectors.where("id = 3").collect()[0]["embedding"]]
    assert [r["id"] for r in search.semantic_search(vectors, q, 10, min_score=None).collect()] == brute(vectors, q)[:10]
    assert [r["id"] for r in search.semantic_search(vectors, q, 2).collect()] == [3, 104]  # a tie goes to the smaller id
    assert [r["id"] for r in search.semantic_search(vectors, q, 99, language="go", min_score=None).collect()] == brute(vectors, q, lambda r: r["language"] == "go")
    assert search.semantic_search(vectors, q, 0).count() == 0
    assert search.semantic_search(vectors, [0.0] * 4).count() == 0
    assert search.semantic_search(vectors, []).count() == 0
    assert all(r["score"] >= 0.5 for r in search.semantic_search(vectors, q, 50, min_score=0.5).collect())
    assert [r["id"] for r in search.related_chunks(vectors, q, "/r0/f3.py").collect()] == brute(vectors, q, lambda r: r["file_path"] != "/r0/f3.py")[:5]
    assert "TakeOrderedAndProject" in search.semantic_search(vectors, q, 5)._jdf.queryExecution().toString()


@pytest.mark.parametrize("block,per_pass", [(4096, 65_536), (3, 65_536), (2, 5)])
def test_batch_search(spark, vectors, block, per_pass):
    q = vectors.where("id % 5 = 0").select(F.col("id").alias("query_id"), "embedding")
    got = {}
    for r in search.batch_search(vectors, q, 4, dim=4, block=block, per_pass=per_pass).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    want = {r["id"]: brute(vectors, r["embedding"])[:4] for r in vectors.where("id % 5 = 0 and id < 100").collect()}
    assert got == want


def test_context_and_stats(spark, vectors):
    ctx = search.file_context(vectors, "/r0/z.py", [1.0, 0.0, 0.0, 0.0], 3).collect()
    assert [r["id"] for r in ctx if r["kind"] == "chunk"] == [100, 101, 104, 103, 102]  # null lines last
    assert len([r for r in ctx if r["kind"] == "related"]) == 3
    assert search.file_context(vectors, "/none").count() == 0
    assert tuple(search.stats(vectors).collect()[0]) == (45, 16, 2)
    assert tuple(search.stats(vectors.where("false")).collect()[0]) == (0, 0, 0)


def test_merge_latest(spark):
    df = spark.createDataFrame([(1, "f", None, None, 5), (2, "f", None, None, 7), (3, "f", "s", 1, None), (4, "f", "s", 1, 2), (5, "f", "s", 1, 2)], "id bigint, file_path string, symbol string, start_line int, t int").withColumn("created_at", F.timestamp_seconds("t"))
    assert {r["id"] for r in search.merge_latest(df).collect()} == {2, 5}


def ts(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.timestamp_seconds(c))
    return df


def test_projects(spark):
    p = ts(spark.createDataFrame([(1, "/r/a", 10, 5, {"name": "A"}), (2, "/r/a_b", None, None, None), (3, "/r/a/sub", 20, 1, {})], "id int, path string, last_indexed int, total_chunks int, metadata map<string,string>"), "last_indexed")
    files = spark.createDataFrame([("/r/a/x",), ("/r/a_b/x",), ("/r/axb/x",), ("/r/a/sub/y",)], "file_path string")
    assert {(r["file_path"], r["project"]) for r in projects.project_of(files, p).collect()} == {("/r/a/x", "/r/a"), ("/r/a_b/x", "/r/a_b"), ("/r/axb/x", None), ("/r/a/sub/y", "/r/a/sub")}
    assert [(r["id"], r["name"]) for r in projects.list_projects(p).collect()] == [(3, "sub"), (1, "A"), (2, "a_b")]
    new = spark.createDataFrame([("/r/a", "new"), ("/r/n", "n"), ("/r/n", "m")], "path string, name string")
    got = {r["path"]: (r["total_chunks"], r["name"]) for r in projects.upsert_projects(p, new).collect()}
    assert got == {"/r/a": (5, "new"), "/r/a_b": (0, None), "/r/a/sub": (1, None), "/r/n": (0, "n")}
    disk = ts(spark.createDataFrame([("/r/a/x", 10), ("/r/a/y", 11), ("/r/a/z", None), ("/r/a_b/q", 1), ("/o", 99), ("/r/a/y", 3)], "path string, mtime int"), "mtime")
    assert {r["path"] for r in projects.changed_files(disk, p).collect()} == {"/r/a/y", "/r/a/z", "/r/a_b/q"}
    idx = ts(spark.createDataFrame([("/r/a/x", 10), ("/r/a/y", 10), ("/r/a/gone", 1)], "file_path string, mtime int"), "mtime")
    plan = {r["path"]: r["state"] for r in projects.incremental_plan(disk, idx).collect()}
    assert plan == {"/r/a/x": "same", "/r/a/y": "changed", "/r/a/z": "new", "/r/a_b/q": "new", "/o": "new", "/r/a/gone": "deleted"}
    rep = {r["project"]: r["report"] for r in projects.reindex_report(disk, idx, p).collect()}
    assert rep == {"/r/a": "2 files, 1 purged", "/r/a_b": "1 files, 0 purged", "/r/a/sub": "up to date"}


def test_quality(spark):
    c = spark.createDataFrame([("f", "open the door"), ("f", "Door"), ("g", "nothing"), ("h", None)], "file_path string, content string")
    q = spark.createDataFrame([(1, "door door THE"), (2, "zzz"), (3, "  ")], "query_id int, query_text string")
    assert {tuple(r) for r in quality.grep_naive(c, q).collect()} == {(1, 1, 4), (2, 0, 0), (3, 0, 0)}
    assert {tuple(r) for r in quality.grep_smart(c, q).collect()} == {(1, "f", 3, 4)}
    res = [(1, "m", 1, k, k, 0.9 - k / 10, 100) for k in range(1, 6)] + [(2, "m", 2, 1, 7, 0.5, 100), (2, "m", 2, 1, 7, 0.5, 100), (2, "m", 2, 2, 7, None, 100), (2, "m", 2, 3, 8, math.nan, 1)]
    r = spark.createDataFrame(res, "run_id bigint, model string, query_id int, rank int, chunk_id bigint, score double, tokens bigint")
    row = quality.top_means(r).collect()[0]
    assert (row["n_runs"], row["top1"], row["top3"], row["top5"]) == (2, 0.65, 0.35, 0.3)
    base = spark.createDataFrame([(1, 600), (2, 600)], "query_id int, n_tokens bigint")
    assert quality.context_reduction(r, base).collect()[0]["reduction"] == 2.0
    assert quality.context_reduction(r.withColumn("tokens", F.lit(0).cast("bigint")), base).collect()[0]["reduction"] == 0.0
    assert quality.top_means(r.where("false")).count() == 0


def test_embedding(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "  "), (4, "beta alpha")], "id int, content string")
    got = {r["id"]: r["embedding"] for r in embed(df, HashingProvider).collect()}
    assert got[2] is None and got[3] is None and got[1] == got[4] and np.linalg.norm(got[1]) == pytest.approx(1)
    calls = []

    def flaky(body):
        calls.append(body)
        if len(calls) < 3:
            raise OSError
        return {"embedding": [1, 2]}

    assert HttpProvider("m", "", 2, pause=0, send=flaky).embed(["x" * 50]) == [[1.0, 2.0]]
    assert HttpProvider("m", "", 2, pause=0, max_chars=3, send=lambda b: {"embedding": [1]}).embed(["xxxx"]) == [None]
    assert create_provider("hashing").dim == 64
    with pytest.raises(ValueError):
        create_provider("hashing", "nowhere")
