import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.api import context_text
from codelode.operators import quality, search
from codelode.operators.embed import HashingProvider, LocalProvider, create_provider
from codelode.operators.store import MAX_LAYERS, Store
from codelode.sources.fs import Folder


def rows(spark, paths, symbol="s", content="c", created=1):
    return spark.createDataFrame([(k, p, symbol, f"{content}{k}") for k, p in enumerate(paths)], "id bigint, file_path string, symbol string, content string").select(
        "id", "file_path", F.lit("python").alias("language"), "symbol", "content", F.lit(None).cast("string").alias("summary"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"),
        F.create_map(F.lit("type"), F.lit("definition")).alias("metadata"), F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit(None).cast("timestamp").alias("mtime"),
        F.timestamp_seconds(F.lit(created)).alias("created_at"), F.timestamp_seconds(F.lit(created)).alias("updated_at"),
    )


def test_layers(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "file_path string")
    assert s.replace("/r", rows(spark, ["/r/a", "/r/b", "/r/c"]), dim=1) == 3
    s.replace("/r_2", rows(spark, ["/r_2/a", "/r_2/sub/b"]))
    assert s.apply("/r", rows(spark, ["/r/b"], content="new"), paths("/r/b", "/r/c")) == {"written": 1, "total": 2}
    got = lambda repo=None: {(r["file_path"], r["content"]) for r in s.chunks(repo).collect()}
    assert got("/r") == {("/r/a", "c0"), ("/r/b", "new0")} and ("/r_2/a", "c0") in got() and len(got()) == 4
    assert got("/r_2/sub") == {("/r_2/sub/b", "c1")} and got("/nowhere") == set() and len(got("/")) == 4
    for k in range(MAX_LAYERS + 3):  # merged on the way; every version is right
        s.apply("/r", rows(spark, ["/r/b"], content=f"v{k}-"), paths("/r/b"))
        assert got("/r") == {("/r/a", "c0"), ("/r/b", f"v{k}-0")}
    assert len(s.manifest()["repos"]["/r"]) <= MAX_LAYERS and len(s._versions()) <= 10
    with pytest.raises(ValueError):
        s.replace("/r", rows(spark, ["/r/a"]), dim=2)


def test_upsert_into_the_table(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    s.replace("/r", rows(spark, ["/r/a", "/r/b"]).unionByName(rows(spark, ["/r/a"], symbol=None)))
    new = rows(spark, ["/r/a"], content="n", created=0).unionByName(rows(spark, ["/r/a"], symbol=None, content="m")).unionByName(rows(spark, ["/r/d"]))
    s.upsert("/r", new.unionByName(new))
    assert {(r["file_path"], r["symbol"], r["content"]) for r in s.chunks("/r").collect()} == {("/r/a", "s", "n0"), ("/r/a", None, "m0"), ("/r/b", "s", "c1"), ("/r/d", "s", "c0")}


def test_one_writer_per_version(spark, tmp_path):
    f = Folder(spark, str(tmp_path / "t"))
    assert f.create("a", "é") and not f.create("a", "x") and f.read("a") == "é" and f.names() == ["a"]
    s = Store(spark, str(tmp_path / "t"))
    s.replace("/r", rows(spark, ["/r/a"]))
    old = s.manifest()
    s.replace("/q", rows(spark, ["/q/a"]))
    s._commit("/r", old, lambda m: m["projects"]["/r"].update(name="x"))  # another repository changed: fine
    s.replace("/r", rows(spark, ["/r/b"]))
    with pytest.raises(RuntimeError):
        s._commit("/r", old, lambda m: None)
    assert s.manifest()["projects"]["/r"]["name"] == "x"


class Model:
    def __init__(self, name):
        self.name = name

    def encode(self, texts, batch_size, show_progress_bar, normalize_embeddings):
        assert len(texts) <= 2 and max(map(len, texts)) <= 5
        return np.array([[len(t), 3.0] if t != "bad" else [float("nan"), 1.0] for t in texts])


def test_models_in_process():
    p = LocalProvider("org/name", dim=2, max_chars=5, batch=2, load=Model)
    got = p.embed(["abcdefgh", "x", "bad", "y"])
    assert got[2] is None and np.linalg.norm(got[0]) == pytest.approx(1) and got[0][0] / got[0][1] == pytest.approx(5 / 3) and p.embed([]) == []
    known = create_provider("modernbert-embed-base")
    assert (known.dim, known.max_chars, known.model_id) == (768, 32_768, "nomic-ai/modernbert-embed-base") and create_provider("org/x").model_id == "org/x"
    with pytest.raises(ValueError):
        LocalProvider("nothing")
    try:
        import sentence_transformers  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="sentence-transformers"):
            known.embed(["x"])
    assert HashingProvider().embed(["a " * 40_000 + "b"]) != HashingProvider().embed(["a " * 40_000])


def test_word_counts_equal_a_loop(spark):
    r = random.Random(4)
    texts = ["".join(r.choices("abA é\n", k=r.randint(0, 60))) for _ in range(60)] + [None, "aaaa"]
    df = spark.createDataFrame([(f"f{k % 7}", t) for k, t in enumerate(texts)], "file_path string, content string").repartition(3)
    words = ["a", "aa", "ab", "aba", "é"]
    for lower in (False, True):
        sizes, found = quality.word_counts(df, words, lower, True)
        want = {}
        for k, t in enumerate(texts):
            for w in words:
                c = (t.lower() if lower else t).count(w) if t else 0
                want[f"f{k % 7}", w] = want.get((f"f{k % 7}", w), 0) + c
        assert {(x["file_path"], x["word"]): x["c"] for x in found.collect()} == {k: c for k, c in want.items() if c}
        assert {x["file_path"]: x["n"] for x in sizes.collect()} == {f"f{j}": sum(len(t or "") for t in texts[j::7]) for j in range(7)}
    sizes, found = quality.word_counts(df, [], False, False)
    assert found.count() == 0 and sizes.count() == 7


def test_regex_grep_and_result_document(spark, tmp_path):
    df = spark.createDataFrame([("f", "open a door"), ("f", "Door"), ("g", "dooor"), ("h", None)], "file_path string, content string")
    assert {tuple(r) for r in quality.grep_regex(df, ["do+r", "x"]).collect()} == {("f", 1, 11), ("g", 1, 5)} and quality.grep_regex(df, []).count() == 0
    c = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, None)], "id bigint, content string")
    q = spark.createDataFrame([(7, "beta")], "query_id int, query_text string")
    out = quality.run_models(c, q, {"m": HashingProvider, "n": lambda: HashingProvider(8)})
    assert {(r["model"], r["query_id"], r["chunk_id"]) for r in out.where("rank = 1").collect()} == {("m", 7, 1), ("n", 7, 1)}
    quality.write_json(out, str(tmp_path / "out"))
    docs = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(d["model"] for d in docs) == ["m", "n"] and [h["rank"] for h in docs[0]["hits"]] == [1, 2] and docs[0]["written_at"]


def test_numbers_over_all_tasks(spark):
    df = spark.createDataFrame([(k, None if k % 10 == 0 else (k * 7919) % 500) for k in range(2000)], "id bigint, line int").repartition(5)
    order = [F.asc_nulls_last("line"), F.asc("id")]
    a, b = (search.numbered(df, order, large).select("id", "position") for large in (10_000, 100))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert search.numbered(df.where("false"), order).count() == 0


def test_details_and_context_text(spark):
    c = rows(spark, ["/r/a", "/r/b"])
    hits = search.semantic_search(c, [1.0], 1)
    full = search.with_details(hits, c).collect()
    assert len(full) == 1 and full[0]["content"] == "c0" and full[0]["metadata"] == {"type": "definition"} and full[0]["summary"] is None
    assert search.with_details(hits.where("false"), c).count() == 0
    own = [{"symbol": None, "start_line": None, "end_line": 3}]
    text = context_text({"file_path": "/r/a", "file_chunks": own, "related_chunks": [{"file_path": "/r/b", "symbol": "s", "start_line": 1, "end_line": 2, "score": 0.5}], "file_content": "x\n" * 30})
    assert "/r/b:1-2 s (0.500)" in text and "<anonymous> (lines ?-3)" in text and "... (11 more lines)" in text
