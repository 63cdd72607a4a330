"""The facade: one object over a store and a provider, with the argument checks of the service."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.operators import index, projects, search
from codelode.operators.embed import HashingProvider, Provider
from codelode.operators.store import Store
from codelode.sources.repo import read_text


class Engine:
    """Indexes repositories and searches them."""

    def __init__(self, spark: SparkSession, root: str, make: Callable[[], Provider] = HashingProvider):
        self.store, self.make = Store(spark, root), make

    def _vector(self, text: str) -> list[float]:
        provider = self.make()
        try:
            return provider.embed([text])[0] or []
        finally:
            provider.close()

    def index_repository(self, repo_path: str, force_reindex: bool = False, project_name: str | None = None) -> dict:
        return index.index_repository(self.store, repo_path, force_reindex, project_name, self.make)

    def semantic_search(self, query: str, top_k: int = 10, language: str | None = None, file_pattern: str | None = None, repo_path: str | None = None, min_score: float = 0.3) -> DataFrame:
        """Hits of a text query. ``top_k`` lies in 1..50, ``min_score`` in 0..1."""
        if not 1 <= top_k <= 50:
            raise ValueError("top_k must be 1 to 50")
        if not 0 <= min_score <= 1:
            raise ValueError("min_score must be 0 to 1")
        chunks = self.store.chunks(repo_path or None)
        return search.with_details(search.semantic_search(chunks, self._vector(query), top_k, language, file_pattern, repo_path, min_score), chunks)

    def get_file_context(self, file_path: str, focus: str | None = None, top_k: int = 5, max_chunks: int = 10_000) -> dict:
        """The file as it is now, its chunks, and with a focus the related chunks of other files.

        A file of more than ``max_chunks`` chunks is an error, as all of them reach the driver here.
        """
        if not 1 <= top_k <= 20:
            raise ValueError("top_k must be 1 to 20")
        c = self.store.chunks()
        found = search.file_chunks(c, file_path).limit(max_chunks + 1).collect()
        if len(found) > max_chunks:
            raise ValueError(f"the file has more than {max_chunks} chunks: page through search.file_chunks instead")
        own = [r.asDict() for r in found]
        vector = self._vector(focus) if focus and own else []
        near = [r.asDict() for r in search.with_details(search.related_chunks(c, vector, file_path, top_k), c).collect()] if vector else []
        return {"file_path": file_path, "file_content": read_text(file_path), "file_chunks": own, "related_chunks": near}

    def get_stats(self, repo_path: str | None = None) -> dict:
        return search.stats(self.store.chunks(repo_path or None), repo_path).collect()[0].asDict()

    def list_projects(self) -> list[dict]:
        return [r.asDict() for r in projects.list_projects(self.store.projects()).collect()]  # the registry

    def remove_repository(self, repo_path: str) -> int:
        import os

        return self.store.remove(os.path.realpath(repo_path))

    def auto_reindex(self, force: bool = False) -> list[str]:
        return index.auto_reindex(self.store, force, self.make)


def to_json(hits: DataFrame) -> str:
    """Hits as a JSON list; ``[]`` where there is none."""
    return json.dumps([json.loads(x) for x in (r[0] for r in hits.select(F.to_json(F.struct("*"))).collect())])


def context_text(context: dict, lines: int = 20) -> str:
    """A file's context to print: its chunks, related chunks with their scores, and the first lines of the file."""
    span = lambda r: f"{r['start_line'] if r['start_line'] is not None else '?'}-{r['end_line'] if r['end_line'] is not None else '?'}"
    out = [context["file_path"], f"{len(context['file_chunks'])} chunks"]
    out += [f"  {r['symbol'] or '<anonymous>'} (lines {span(r)})" for r in context["file_chunks"]]
    if context["related_chunks"]:
        out.append("Related:")
        out += [f"  {r['file_path']}:{span(r)} {r['symbol'] or ''} ({r['score']:.3f})" for r in context["related_chunks"]]
    if context["file_content"] is not None:
        head = context["file_content"].split("\n")
        out += head[:lines] + ([f"... ({len(head) - lines} more lines)"] if len(head) > lines else [])
    return "\n".join(out)


def to_text(hits: DataFrame, chunks: DataFrame, lines: int = 25) -> str:
    """Hits with the first lines of their content, to print."""
    full = hits if "content" in hits.columns else search.with_details(hits, chunks)
    return "\n\n".join(r["rendered"] for r in search.rendered(full, F.col("content"), lines).collect()) or "No results."
