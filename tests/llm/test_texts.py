import json

import pytest
from pyspark.sql import functions as F

from codelode.llm import encodings, packing, pieces, tokens

TEXTS = [(1, "Hello wörld 👍🏽\r\n\tx = 1"), (2, ""), (3, None), (4, "<|endoftext|> is text"), (5, "a" * 30_000), (1, "Hello wörld 👍🏽\r\n\tx = 1"), (6, " \n")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("__text", F.lit(1)).withColumn("n_tokens", F.lit(0))


# ---- tokens


def test_round_trip(spark, texts):
    enc = tokens.encode(texts)
    assert enc.columns == ["doc_id", "ids"] and enc.count() == len(TEXTS)
    assert sorted(tuple(r) for r in tokens.decode(enc).collect()) == sorted((i, t or "") for i, t in TEXTS)
    assert [r["ids"] for r in enc.where("doc_id in (2, 3)").collect()] == [[], []]
    assert 50256 not in enc.where("doc_id = 4").collect()[0]["ids"]
    assert tokens.encode(texts.where("false")).count() == 0


def test_offsets_cover_the_text(spark, texts):
    for r in tokens.encode(texts, offsets=True).where("doc_id in (1, 4)").collect():
        t = dict(TEXTS)[r["doc_id"]]
        assert r["starts"][0] == 0 and r["ends"][-1] == len(t) and all(a <= b for a, b in zip(r["starts"], r["ends"]))


def test_split_characters_and_table():
    ids = tokens.load().encode("👍").ids
    assert len(ids) > 1 and tokens.decode_ids(ids) == "👍"
    assert "�" in tokens.decode_ids(ids[:1]) and tokens.decode_ids(None) is None and tokens.decode_ids([]) == ""
    table = tokens.byte_to_char()
    assert len(set(table.values())) == 256 and table[32] == "Ġ"
    vocab = json.load(open(tokens.VOCABULARY))["model"]["vocab"]
    assert tokens.id_bytes()[vocab["Ġthe"]] == b" the"


# ---- packing


def test_bounds_and_best_fit():
    import numpy as np

    assert packing.lower_bound(np.array([6]), np.array([5]), 10) == 5  # two never fit together
    assert packing.lower_bound(np.array([4]), np.array([5]), 10) == 3
    assert packing.lower_bound(np.array([]), np.array([]), 10) == 0
    r = np.random.default_rng(1)
    for _ in range(30):
        s = r.integers(1, 11, size=r.integers(1, 40))
        where, used = packing.best_fit_decreasing(s, 10)
        assert used.max() <= 10 and used.sum() == s.sum() and (np.bincount(where, weights=s) == used).all()
        u, c = np.unique(s, return_counts=True)
        assert packing.lower_bound(u, c, 10) <= len(used)


@pytest.mark.parametrize("group", [7, 1000])
def test_packing_is_whole(spark, group):
    rows = [(k, 0, 1 + (k * 7919) % 99) for k in range(500)] + [(1000, 0, 100), (1000, 1, 100), (1000, 2, 3), (7, 0, 50), (7, 0, 50), (2000, 0, 0)]
    items = spark.createDataFrame(rows, "id bigint, piece_no int, n int").repartition(5)
    out, info = packing.pack_items(items, 100, group_items=group)
    got = out.collect()
    assert sorted((r["id"], r["piece_no"], r["n"]) for r in got) == sorted(x for x in rows if x[2])
    used = {}
    for r in got:
        used[r["container"]] = used.get(r["container"], 0) + r["n"]
    assert max(used.values()) <= 100 and len(used) == info["containers"] >= info["lower_bound"]
    if group == 1000:
        assert info["containers"] <= info["lower_bound"] + 1


def test_pack_documents(spark, texts):
    out, info = packing.pack_documents(texts, capacity=8)
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == {1, 4, 5, 6} and info["containers"] == len({r["container"] for r in rows})
    long = sorted((r["start_token"], r["n_tokens"]) for r in rows if r["doc_id"] == 5)
    assert all(n == 8 for _, n in long[:-1]) and [s for s, _ in long] == list(range(0, 8 * len(long), 8))
    empty, info = packing.pack_documents(texts.where("false"))
    assert empty.count() == 0 and info["containers"] == info["lower_bound"] == 0


# ---- pieces


def test_pieces(spark):
    code = "".join(f"def f{k}():\r\n    x = {k}\r\n    return 'é'\r\n\r\n" for k in range(120))
    rows = [(1, code, 10), (2, "z" * 4500, None), (3, "short", 1), (4, "", 1), (5, None, 1), (6, "a" * 2000, 1), (7, "a" * 2001, 1), (8, "👍" * 2500, 1), (8, "👍" * 2500, 1)]
    df = spark.createDataFrame(rows, "id bigint, content string, start_line int").withColumn("piece_no", F.lit("clash"))
    got = {}
    for r in pieces.split_pieces(df).orderBy("id", "piece_no").collect():
        got.setdefault(r["id"], []).append(r)
    assert set(got) == {1, 2, 3, 4, 6, 7, 8} and [len(got[k]) for k in (3, 4, 6)] == [1, 1, 1] and len(got[8]) == 4
    for k in (1, 2, 7):
        text, parts = rows[k - 1][1], got[k]
        assert "".join(p["content"][p["overlap_chars"] :] for p in parts) == text
        assert all(len(p["content"]) <= 2000 for p in parts)
        for a, b in zip(parts, parts[1:]):
            n = b["overlap_chars"]
            assert 1 <= n <= 200 and a["content"].endswith(b["content"][:n])
    at = 0
    for p in got[1]:
        assert p["content"].startswith("def f")or p["overlap_chars"], "cut before a definition"
        first = text_at = code.index(p["content"], max(0, at - 200))
        assert p["start_line"] == 10 + code.count("\n", 0, first)
        last = p["piece_no"] + 1 == p["n_pieces"]
        assert p["end_line"] == 10 + code.count("\n", 0, text_at + len(p["content"]) - (not last))
        at = text_at + len(p["content"])
    assert all(p["content"][p["overlap_chars"] :].startswith("def f") for p in got[1])
    assert got[2][0]["start_line"] is None
    assert pieces.split_pieces(df.where("false")).count() == 0
    assert {r["id"] for r in pieces.split_pieces(df, keep_small=False).collect()} == {1, 2, 7, 8}
    with pytest.raises(ValueError):
        pieces.split_pieces(df, overlap=2000)


# ---- encodings

GOOD = ["Größe über alles – „gut“", "SÃO PAULO, NÃO", "5 µm ± 0.2 °C, § 4, £20, ½", "λ → β ∈ Ω", "├── a\n│   └── b", "🙂 👍🏽 nice", "Привет, мир! «да»", "削除処理は215件のファイルで空の結果を返す。", "ÅNGSTRÖM", "zażółć gęślą jaźń", "¿Por qué? señor", "l’été déjà créée", "á ë", "The word `fÃ¼r` is quoted"]
BAD = [("utf-8", "cp1252", "L’été déjà – señor"), ("utf-8", "latin-1", "größer über"), ("utf-8", "cp437", "größer über"), ("utf-8", "mac_roman", "déjà vu à"), ("utf-8", "cp1251", "последнюю строку"), ("cp1251", "cp1252", "последнюю строку"), ("cp1252", "cp437", "réponse différée"), ("cp932", "cp1252", "検索索引が空の結果を返すため"), ("iso8859-2", "latin-1", "źródeł dłużej główny")]


@pytest.mark.parametrize("text", GOOD)
def test_good_texts_stay(text):
    assert encodings.restore(text) == (text, 0, 0, 0)


@pytest.mark.parametrize("real,shown,text", BAD)
def test_bad_texts_come_back(real, shown, text):
    table = {b: chr(c) for c, b in encodings._table(shown, 0x100).items()}
    wrong = "".join(table[b] for b in text.encode(real))
    new, n, lost, cut = encodings.restore(wrong)
    assert n > 0 and lost == cut == 0 and new == text


@pytest.mark.parametrize("real,shown", [("utf-8", "latin-1"), ("cp932", "latin-1"), ("euc_jp", "latin-1")])
def test_long_tokens_come_back_whole(real, shown):
    text = ("これは長い日本語の文章です。検索の索引を作り、結果を返します。" * 400)[:3400]
    wrong = text.encode(real).decode(shown)
    assert len(wrong) >= 6800 and encodings.restore(wrong) == (text, 1, 0, 0)
    assert encodings.restore("x" * 1001 + wrong)[0] == "x" * 1001 + text


def test_cost_counts_equal_neighbours():
    for t in ("", "a", "Ã¤", "cafÃ© " * 30, "これは、" * 40 + "ä–x"):
        assert abs(encodings.cost(t) - sum(encodings._pair_cost(a, b) for a, b in zip(" " + t[:-1], t) if t)) < 1e-9


def test_twice_and_losses(spark):
    twice = "café – naïve".encode().decode("cp1252").encode().decode("cp1252")
    assert encodings.restore(twice)[0] == "café – naïve"
    assert encodings.restore("don�t") == ("don�t", 1, 1, 0)
    assert encodings.restore("only `�` quoted") == ("only `�` quoted", 0, 0, 0)
    rows = [(1, twice), (2, None), (3, ""), (4, "plain"), (5, "x�"), (5, "x�"), (6, "cafÃ© " * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_lost", F.lit("clash"))
    assert sorted(r["doc_id"] for r in encodings.restore_encoding(df).collect()) == [1, 5, 5, 6]
    every = {r["doc_id"]: r["text"] for r in encodings.restore_encoding(df, only_wrong=False).collect()}
    assert every[2] is None and every[3] == "" and every[6] == "café " * 5000
    assert encodings.restore_encoding(df.where("false")).count() == 0
