import os
import time

import pytest

from codelode.api import Engine, to_json, to_text
from codelode.cli import parser, run
from codelode.sources.repo import RepoReader, read_text, repo_files, split_walk, walk

FUNC = "def {0}(a):\n    " + '"""Reads the {0} and returns what it holds, for tests of the index."""\n    return [a, "{0}", a, a, a]\n'


@pytest.fixture()
def repo(tmp_path):
    r = tmp_path / "my_repo"
    files = {
        "pkg/__init__.py": FUNC.format("init"), "pkg/_util.py": FUNC.format("util"), ".conf.json": '{"a": "' + "x" * 120 + '"}', "pkg/mod.py": FUNC.format("alpha") + "\n\n" + FUNC.format("beta"),
        "pkg/flat.py": "x = 1\n" * 40, "pkg/bad.py": "def (:\n" + "y = 2\n" * 40, "empty.py": "", "blank.py": " \n\n", "UPPER.PY": "x", "notes.md": "word " * 60, "node_modules/x.js": "x" * 200, ".hidden/x.py": "x = 1\n" * 40, ".git/x.py": "x",
    }
    for name, text in files.items():
        p = r / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (r / "raw.py").write_bytes(b"# \xff\xfe\r\n" + b"z = 3\r\n" * 40)
    (tmp_path / "my-repo").mkdir()
    (tmp_path / "my-repo" / "o.py").write_text(FUNC.format("other"))
    return r


def test_walk_and_read(spark, repo):
    names = [os.path.relpath(p, repo) for p in walk(str(repo))]
    assert names == [".conf.json", "blank.py", "empty.py", "notes.md", "raw.py", "pkg/__init__.py", "pkg/_util.py", "pkg/bad.py", "pkg/flat.py", "pkg/mod.py"]
    rows = {os.path.relpath(r["path"], repo): r for r in repo_files(spark, str(repo)).collect()}
    assert set(rows) == set(names) and "\r" not in rows["raw.py"]["content"] and "�" in rows["raw.py"]["content"]
    assert rows["pkg/mod.py"]["language"] == "python" and rows["pkg/mod.py"]["mtime"] is not None
    assert read_text(str(repo / "nowhere.py")) is None
    with pytest.raises(ValueError):
        repo_files(spark, str(repo / "nowhere"))


@pytest.mark.parametrize("trees", [1, 2, 3, 64])
def test_parts_of_a_walk(repo, trees):
    for k in range(9):
        (repo / "deep" / f"d{k % 3}" / f"e{k}").mkdir(parents=True)
        (repo / "deep" / f"d{k % 3}" / f"e{k}" / "x.py").write_text("x")
    (repo / "link").symlink_to(repo / "deep")
    (repo / "none").mkdir()
    files, folders = split_walk(str(repo), trees)
    assert sorted(files + [p for f in folders for p in walk(f)]) == sorted(walk(str(repo))) and (trees == 64 or folders)
    reader = RepoReader({"path": str(repo), "trees": str(trees), "filesperpartition": "2", "content": "false"}, [])
    got = [p for part in reader.partitions() for b in reader.read(part) for p in b.column(0).to_pylist()]
    assert sorted(got) == sorted(walk(os.path.realpath(repo)))


def test_life_of_an_index(spark, repo, tmp_path):
    e = Engine(spark, str(tmp_path / "table"))
    root = str(repo)
    s = e.index_repository(root)
    assert s["files_found"] == 10 and s["chunks_written"] == s["total_chunks"] > 0
    symbols = {r["symbol"] for r in e.store.chunks().select("symbol").collect()}
    assert {"init", "util", "alpha", "beta", "<block_1>"} <= symbols
    assert e.store.chunks().where("file_path like '%hidden%' or file_path like '%node_modules%'").count() == 0
    e.index_repository(str(tmp_path / "my-repo"), project_name="other")
    assert e.get_stats(root)["total_chunks"] == s["total_chunks"]
    hits = e.semantic_search("reads the alpha", min_score=0.0)
    assert hits.collect()[0]["symbol"] in ("alpha", "beta", "init", "util", "other") and to_json(hits).startswith("[{") and "score" in to_json(hits)
    assert to_text(hits, e.store.chunks()) and to_json(hits.where("false")) == "[]"
    ctx = e.get_file_context(str(repo / "pkg" / "mod.py"), "alpha")
    assert len(ctx["file_chunks"]) == 2 and ctx["related_chunks"] and "alpha" in ctx["file_content"]
    assert e.get_file_context(str(repo / "pkg" / "mod.py"))["related_chunks"] == []
    assert e.index_repository(root)["files_changed"] == 0

    old = time.time() - 10_000
    (repo / "pkg" / "flat.py").write_text("w = 5\n" * 60)
    (repo / "late.py").write_text(FUNC.format("late"))
    os.utime(repo / "late.py", (old, old))  # new to the index, though old on disk
    (repo / "pkg" / "_util.py").unlink()
    os.utime(repo / "pkg" / "flat.py", (time.time() + 5, time.time() + 5))
    s = e.index_repository(root)
    assert (s["files_changed"], s["orphan_files"], s["orphan_chunks_purged"]) == (2, 1, 1)
    symbols = {r["symbol"] for r in e.store.chunks(root).select("symbol").collect()}
    assert "late" in symbols and "util" not in symbols and "alpha" in symbols
    assert e.store.chunks(root).where("content like 'w = 5%'").count() == 1
    assert e.index_repository(root, force_reindex=True)["files_changed"] == 10
    assert [x.rsplit(": ")[-1] for x in e.auto_reindex()][0] == "up to date"
    assert e.store.delete_files(root, spark.createDataFrame([(str(repo / "late.py"),)], "file_path string")) == 1
    assert e.store.delete_files(root, spark.createDataFrame([], "file_path string")) == 0
    n = e.get_stats(root)["total_chunks"]
    assert e.remove_repository(root) == n and e.get_stats(root)["total_chunks"] == 0 and e.get_stats()["total_chunks"] == 1
    assert [p["name"] for p in e.list_projects()] == ["other"]


def test_arguments(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "t"))
    for bad in (dict(top_k=0), dict(top_k=51), dict(min_score=2)):
        with pytest.raises(ValueError):
            e.semantic_search("x", **bad)
    with pytest.raises(ValueError):
        e.get_file_context("x", top_k=21)
    with pytest.raises(ValueError):
        e.index_repository(str(tmp_path / "nowhere"))
    assert e.semantic_search("x").count() == 0 and e.semantic_search("").count() == 0
    assert run(parser().parse_args(["--root", "x", "stats"]), e) == '{"total_chunks": 0, "total_files": 0, "total_languages": 0}'
    assert run(parser().parse_args(["--root", "x", "projects"]), e) == ""


def test_dimension_is_checked(spark, repo, tmp_path):
    from codelode.operators.embed import HashingProvider

    e = Engine(spark, str(tmp_path / "t"))
    e.index_repository(str(tmp_path / "my-repo"))
    e.make = lambda: HashingProvider(32)
    with pytest.raises(ValueError):
        e.index_repository(str(repo))
