import json
import threading
import urllib.error
import urllib.request

import pytest

from codelode import server
from codelode.api import Engine

FUNC = "def {0}(a):\n    " + '"""Reads the {0} and returns what it holds, for tests of the server, whatever it is."""\n    return [a, "{0}", a, a, a]\n'


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("srv")
    (root / "repo").mkdir()
    (root / "repo" / "a.py").write_text(FUNC.format("alpha"))
    return Engine(spark, str(root / "table")), str(root / "repo")


def test_http(engine):
    e, repo = engine
    httpd = server.serve(e, port=0)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{httpd.server_address[1]}"

    def call(method, path, body=None):
        req = urllib.request.Request(base + path, None if body is None else json.dumps(body).encode(), method=method)
        try:
            with urllib.request.urlopen(req) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as err:
            return err.code, json.load(err)

    try:
        assert call("GET", "/health") == (200, {"status": "ok"}) and call("GET", "/nothing")[0] == 404
        assert call("POST", "/index", {"repo_path": repo, "project_name": "p"})[1]["chunks_written"] == 1
        assert call("POST", "/index", {"repo_path": repo + "/nowhere"})[0] == 400
        status, found = call("POST", "/search", {"query": "reads the alpha", "min_score": 0.0})
        assert status == 200 and found["total"] == 1 and found["results"][0]["symbol"] == "alpha" and "Reads the alpha" in found["results"][0]["content"]
        assert [call("POST", "/search", b)[0] for b in ({}, {"query": "x", "top_k": 0}, {"query": "x", "top_k": True}, {"query": 3}, {"query": "x", "other": 1}, [1])] == [400] * 6
        assert len(call("POST", "/file-context", {"file_path": repo + "/a.py"})[1]["file_chunks"]) == 1
        assert call("GET", f"/stats?repo_path={repo}")[1] == {"total_chunks": 1, "total_files": 1, "total_languages": 1}
        assert call("GET", "/projects")[1]["projects"][0]["name"] == "p"
    finally:
        httpd.shutdown()


def test_tools(engine):
    e, repo = engine
    said = []
    ask = lambda method, **params: {"jsonrpc": "2.0", "id": 1, "method": method, "params": params}
    tool = lambda name, **args: ask("tools/call", name=name, arguments=args)
    messages = [ask("initialize"), {"jsonrpc": "2.0", "method": "notifications/initialized"}, ask("tools/list"), tool("reindex", repo_path=repo), tool("search", query="reads the alpha", min_score=0.0), tool("get_file_context", file_path=repo + "/a.py"), tool("stats"), tool("list_projects"), tool("search"), tool("nothing"), ask("other")]
    server.serve_tools(e, [json.dumps(m) for m in messages] + ["", "{"], lambda x: said.append(json.loads(x)))
    texts = [m["result"]["content"][0]["text"] for m in said if "content" in m.get("result", {})]
    assert len(said) == 11 and [t["name"] for t in said[1]["result"]["tools"]][:5] == ["search", "file_context", "stats", "reindex", "list_projects"]
    assert "alpha" in texts[1] and "alpha" in texts[2] and json.loads(texts[3])["total_chunks"] == 1 and repo in texts[4]
    assert texts[5].startswith("Error: query") and texts[6].startswith("Error: unknown tool") and said[-2]["error"]["code"] == -32601 and said[-1]["error"]["code"] == -32700
    assert server.respond(e, "DELETE", f"/repository?repo_path={repo}", b"") == (200, {"repo_path": repo, "chunks_deleted": 1})
