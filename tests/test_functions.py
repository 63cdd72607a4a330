import math

import pytest
from pyspark.sql import functions as F

from codelode.functions import text as X
from codelode.functions import vector as V


def one(spark, col, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v)
    return df.select(col.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("path,want", [("/a/b.c.py", ".py"), ("/a/.env", ""), ("/a/.x.json", ".json"), ("Makefile", ""), ("a.", ""), ("d.ot/file", ""), ("x/UP.PY", ".PY")])
def test_suffix(spark, path, want):
    assert one(spark, X.suffix(F.lit(path))) == want


def test_language_is_case_sensitive_and_defaults(spark):
    assert one(spark, X.language_of(F.lit("a/b.rs"))) == "rust"
    assert one(spark, X.language_of(F.lit("a/b.RS"))) is None
    assert one(spark, X.language_of(F.lit("a/b"), "text")) == "text"


@pytest.mark.parametrize("text,word,n", [("aaaa", "aa", 2), ("abc", "x", 0), ("", "a", 0), ("abc", "", 0), ("ßaßaß", "ßa", 2)])
def test_occurrences(spark, text, word, n):
    assert one(spark, X.occurrences(F.lit(text), word)) == (n if word == "" else text.count(word)) == n


def test_like_takes_escaped_characters_literally(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), ("a\\b",), ("a%",)], "p string")
    hit = lambda p: {r[0] for r in df.where(X.postgres_like(F.col("p"), p)).collect()}
    assert hit("a_b") == {"a_b", "axb", "a\\b"}
    assert hit("a\\_b") == {"a_b"}
    assert hit("a\\%") == {"a%"}
    assert hit("a\\\\b") == {"a\\b"}


def test_folder_characters_are_literal(spark):
    df = spark.createDataFrame([("/r/my_repo/a",), ("/r/my-repo/a",), ("/r/my_repo2/a",)], "p string")
    assert [r[0] for r in df.where(X.under(F.col("p"), "/r/my_repo/")).collect()] == ["/r/my_repo/a"]


def test_preview(spark):
    t = "\n".join(str(k) for k in range(30))
    p = one(spark, X.preview(F.lit(t), 25))
    assert p["more_lines"] == 5 and p["head"].count("\n") == 24 and p["rendered"].endswith("... (5 more lines)")
    assert one(spark, X.preview(F.lit(""), 25))["rendered"] == ""


def test_vectors(spark):
    a, b = F.lit([3.0, 4.0]).cast("array<float>"), F.lit([4.0, 3.0]).cast("array<float>")
    z = F.lit([0.0, 0.0]).cast("array<float>")
    assert one(spark, V.cosine_similarity(a, b)) == pytest.approx(0.96)
    assert one(spark, V.cosine_similarity(a, z)) is None
    assert one(spark, V.cosine_with_epsilon(a, z)) == 0
    assert one(spark, V.dot(a, F.lit([1.0]).cast("array<float>"))) is None
    assert one(spark, V.l2_normalize(a)) == [pytest.approx(0.6), pytest.approx(0.8)]
    assert one(spark, V.l2_normalize(z)) == [None, None]


def test_validity(spark):
    rows = [([1.0, 2.0],), ([0.0, 0.0],), ([math.nan, 1.0],), ([1.0],), (None,), ([None, 1.0],)]
    df = spark.createDataFrame(rows, "v array<float>")
    got = [tuple(r) for r in df.select(V.validity(F.col("v"), 2), V.searchable(F.col("v"), 2)).collect()]
    assert [g[0] for g in got[:5]] == ["ok", "zero", "nan", "wrong_dimension", "missing"]
    assert [g[1] for g in got] == [True, False, False, False, False, False]
