"""The engine over HTTP, and as tools over standard input and output; both with the standard library only.

    python -m codelode.server --root FOLDER [--port 8000 | --tools]

HTTP: POST /index, /search, /file-context; GET /stats, /projects, /health; DELETE /repository.
Wrong arguments are 400, anything else that fails is 500, both with ``{"detail": ...}``. Tools: one
JSON-RPC message a line, with ``initialize``, ``tools/list`` and ``tools/call``; what fails in a
tool comes back as its text. Requests run in threads and share one session, so none blocks others.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TextIO
from urllib.parse import parse_qsl, urlsplit

from codelode.api import Engine, context_text, to_json, to_text

TEXT, WHOLE, FLAG, NUMBER = "string", "integer", "boolean", "number"
#: Arguments of each call: name to (type, whether it must be given).
ARGUMENTS = {
    "index": {"repo_path": (TEXT, True), "force_reindex": (FLAG, False), "project_name": (TEXT, False)},
    "search": {"query": (TEXT, True), "top_k": (WHOLE, False), "language": (TEXT, False), "file_pattern": (TEXT, False), "repo_path": (TEXT, False), "min_score": (NUMBER, False)},
    "file_context": {"file_path": (TEXT, True), "focus": (TEXT, False), "top_k": (WHOLE, False)},
    "stats": {"repo_path": (TEXT, False)},
    "remove": {"repo_path": (TEXT, True)},
    "list_projects": {},
}
ABOUT = {
    "search": "Chunks of the indexed repositories that are most similar to a text.",
    "file_context": "A file with its chunks and, for a focus, related chunks of other files.",
    "stats": "Numbers of chunks, files and languages, of all repositories or one.",
    "reindex": "Brings the index of a repository up to date.",
    "list_projects": "The indexed repositories with their last run and number of chunks.",
    "index_repository": "Indexes a repository.",
    "semantic_search": "Chunks of the indexed repositories that are most similar to a text.",
    "get_file_context": "A file with its chunks and, for a focus, related chunks of other files.",
}
#: Tools and the calls they make; the last three are the second list, by the names of the library.
TOOLS = {"search": "search", "file_context": "file_context", "stats": "stats", "reindex": "index", "list_projects": "list_projects", "index_repository": "index", "semantic_search": "search", "get_file_context": "file_context"}
_KINDS: dict[str, tuple] = {TEXT: (str,), WHOLE: (int,), FLAG: (bool,), NUMBER: (int, float)}


def checked(call: str, given: dict) -> dict:
    """The arguments of a call, without nulls; a ValueError says what is wrong with them."""
    known = ARGUMENTS[call]
    out = {k: v for k, v in given.items() if v is not None}
    for name in out:
        if name not in known:
            raise ValueError(f"unknown argument: {name}")
        kind = known[name][0]
        if not isinstance(out[name], _KINDS[kind]) or kind != FLAG and isinstance(out[name], bool):
            raise ValueError(f"{name} must be of type {kind}")
    for name, (_, must) in known.items():
        if must and not out.get(name):
            raise ValueError(f"{name} is missing")
    return out


def answer(engine: Engine, call: str, given: dict) -> dict:
    """The result of a call as plain values."""
    a = checked(call, given)
    if call == "index":
        return engine.index_repository(**a)
    if call == "search":
        hits = json.loads(to_json(engine.semantic_search(**a)))
        return {"query": a["query"], "results": hits, "total": len(hits)}
    if call == "file_context":
        return engine.get_file_context(**a)
    if call == "stats":
        return engine.get_stats(**a)
    if call == "remove":
        return {"repo_path": a["repo_path"], "chunks_deleted": engine.remove_repository(**a)}
    return {"projects": engine.list_projects()}


# ------------------------------------------------------------------ HTTP

ROUTES = {("POST", "/index"): "index", ("POST", "/search"): "search", ("POST", "/file-context"): "file_context", ("GET", "/stats"): "stats", ("GET", "/projects"): "list_projects", ("DELETE", "/repository"): "remove"}


def respond(engine: Engine, method: str, target: str, body: bytes) -> tuple[int, dict]:
    """(status, answer) of one request."""
    url = urlsplit(target)
    if (method, url.path) == ("GET", "/health"):
        return 200, {"status": "ok"}
    call = ROUTES.get((method, url.path))
    if call is None:
        return 404, {"detail": "no such path"}
    try:
        given = json.loads(body or b"{}") if method == "POST" else dict(parse_qsl(url.query))
        if not isinstance(given, dict):
            raise ValueError("the body must be an object")
        return 200, answer(engine, call, given)
    except ValueError as e:  # malformed JSON is one, too
        return 400, {"detail": str(e)}
    except Exception as e:  # noqa: BLE001 - the caller gets to know
        return 500, {"detail": str(e)[:500]}


def handler(engine: Engine) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _serve(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, out = respond(engine, self.command, self.path, body)
            data = json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _serve

        def log_message(self, *_):
            pass

    return Handler


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is bound and ready for ``serve_forever``."""
    return ThreadingHTTPServer((host, port), handler(engine))


# ------------------------------------------------------------------ tools


def tool_list() -> list[dict]:
    out = []
    for name, call in TOOLS.items():
        known = ARGUMENTS[call]
        out.append({"name": name, "description": ABOUT[name], "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, (t, _) in known.items()}, "required": [k for k, (_, must) in known.items() if must]}})
    return out


def tool_text(engine: Engine, name: str, given: dict) -> str:
    """What a tool says; errors are texts as well."""
    if name not in TOOLS:
        return f"Error: unknown tool: {name}"
    call = TOOLS[name]
    try:
        if call == "search":
            return to_text(engine.semantic_search(**checked(call, given)), engine.store.chunks())
        out = answer(engine, call, given)
    except Exception as e:  # noqa: BLE001 - the caller reads it
        return f"Error: {e}"
    if call == "file_context":
        return context_text(out)
    if call == "list_projects":
        return "\n".join(f"{r['path']}  {r['total_chunks']} chunks  {r['last_indexed'] or 'never'}" for r in out["projects"]) or "No projects."
    return json.dumps(out, default=str)


def tool_reply(engine: Engine, message: dict) -> dict | None:
    """The reply to one message; None for notifications."""
    if "id" not in message:
        return None
    head = {"jsonrpc": "2.0", "id": message["id"]}
    method, given = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return {**head, "result": {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "codelode", "version": "1"}}}
    if method == "ping":
        return {**head, "result": {}}
    if method == "tools/list":
        return {**head, "result": {"tools": tool_list()}}
    if method == "tools/call":
        return {**head, "result": {"content": [{"type": "text", "text": tool_text(engine, given.get("name", ""), given.get("arguments") or {})}]}}
    return {**head, "error": {"code": -32601, "message": f"unknown method: {method}"}}


def serve_tools(engine: Engine, lines: TextIO, write: Callable[[str], object]) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            reply = tool_reply(engine, message) if isinstance(message, dict) else None
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            write(json.dumps(reply) + "\n")


def main(argv: list[str] | None = None) -> int:
    from codelode.session import local_session

    p = argparse.ArgumentParser(prog="codelode.server")
    p.add_argument("--root", required=True, help="folder of the chunk table")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    p.add_argument("--tools", action="store_true", help="serve tools on standard input and output")
    args = p.parse_args(argv)
    engine = Engine(local_session(), args.root)
    if args.tools:
        serve_tools(engine, sys.stdin, lambda x: (sys.stdout.write(x), sys.stdout.flush()))
    else:
        serve(engine, args.host, args.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
