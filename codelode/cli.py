"""Command line: ``python -m codelode.cli --root FOLDER index|search|file-context|stats|projects|remove|reindex``."""

from __future__ import annotations

import argparse
import json
import sys

from codelode.api import Engine, context_text, to_json, to_text
from codelode.session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codelode")
    p.add_argument("--root", required=True, help="folder of the chunk table")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("index")
    x.add_argument("path")
    x.add_argument("--force", action="store_true")
    x.add_argument("--name")
    x = sub.add_parser("search")
    x.add_argument("query")
    x.add_argument("--top-k", type=int, default=10)
    x.add_argument("--language")
    x.add_argument("--file-pattern")
    x.add_argument("--repo")
    x.add_argument("--min-score", type=float, default=0.3)
    x.add_argument("--json", action="store_true")
    x = sub.add_parser("file-context")
    x.add_argument("path")
    x.add_argument("--focus")
    x.add_argument("--top-k", type=int, default=5)
    x.add_argument("--json", action="store_true")
    x = sub.add_parser("stats")
    x.add_argument("--repo")
    sub.add_parser("projects")
    x = sub.add_parser("remove")
    x.add_argument("path")
    x = sub.add_parser("reindex")
    x.add_argument("--force", action="store_true")
    return p


def run(args: argparse.Namespace, engine: Engine) -> str:
    if args.command == "index":
        return json.dumps(engine.index_repository(args.path, args.force, args.name))
    if args.command == "search":
        hits = engine.semantic_search(args.query, args.top_k, args.language, args.file_pattern, args.repo, args.min_score)
        return to_json(hits) if args.json else to_text(hits, engine.store.chunks())
    if args.command == "file-context":
        context = engine.get_file_context(args.path, args.focus, args.top_k)
        return json.dumps(context) if args.json else context_text(context)
    if args.command == "stats":
        return json.dumps(engine.get_stats(args.repo))
    if args.command == "projects":
        return "\n".join(f"{r['path']}  {r['total_chunks']} chunks  {r['last_indexed'] or 'never'}" for r in engine.list_projects())
    if args.command == "remove":
        return str(engine.remove_repository(args.path))
    return "\n".join(engine.auto_reindex(args.force))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print(run(args, Engine(local_session(), args.root)))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
