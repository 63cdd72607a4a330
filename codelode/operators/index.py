"""Indexing a repository: walk, purge, change filter, chunk, embed, swap."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators import chunking
from codelode.operators.embed import HashingProvider, Provider
from codelode.operators.embed import embed as fill
from codelode.operators.store import Store
from codelode.sources.repo import read_files, repo_files


def chunk_rows(files: DataFrame, make: Callable[[], Provider]) -> DataFrame:
    """Chunk-table rows of files; ids are hashes of the natural key and the kind."""
    cut = chunking.chunk_files(files).join(files.select(F.col("path").alias("file_path"), "mtime"), "file_path")
    now = F.current_timestamp()
    return fill(cut, make).select(
        F.xxhash64("file_path", "symbol", "start_line", "kind").alias("id"), "file_path", "language", "symbol", "content", F.lit(None).cast("string").alias("summary"),
        "start_line", "end_line", F.create_map(F.lit("type"), F.col("kind")).alias("metadata"), "embedding", "mtime", now.alias("created_at"), now.alias("updated_at"),
    )


def index_repository(store: Store, repo_path: str, force: bool = False, name: str | None = None, make: Callable[[], Provider] = HashingProvider, model: str = "hashing") -> dict:
    """Brings the index of one repository up to date; returns the figures of the run.

    Files that the last run did not see, or saw with an older modification, are cut and embedded again; chunks of files
    that are gone are dropped; a file that can't be read keeps its chunks. ``force`` takes all
    files. Readers see the old version until the new one is complete.
    """
    started = time.time()
    root = os.path.realpath(repo_path)
    if not os.path.isdir(root):
        raise ValueError(f"not a directory: {repo_path}")
    before = store.upsert_project(root, name)
    spark = store.spark
    disk = repo_files(spark, root, content=False).select("path", "mtime", "length", "language").cache()
    old = store.chunks(root)
    indexed = old.select("file_path").distinct()
    gone = indexed.join(disk.select(F.col("path").alias("file_path")), "file_path", "left_anti").cache()
    todo = disk
    # only what was seen at an older time, or not at all, is opened
    if not force:
        known = store.seen(root).select("path", F.col("mtime").alias("known"))
        same = disk.join(known, "path").where(F.col("mtime") <= F.col("known"))
        todo = disk.join(same, "path", "left_anti")
    n_todo, n_gone = todo.count(), gone.count()
    stats = {"files_found": disk.count(), "files_changed": n_todo, "orphan_files": n_gone, "orphan_chunks_purged": 0, "chunks_written": 0, "total_chunks": before.get("total_chunks") or 0}
    if n_todo or n_gone or force:
        files = read_files(todo).where(F.col("content").isNotNull()).persist(StorageLevel.DISK_ONLY)
        fresh = chunk_rows(files, make)
        stats["orphan_chunks_purged"] = old.join(gone, "file_path", "left_semi").count()
        void = gone.unionByName(files.select(F.col("path").alias("file_path")))
        listing = disk.select("path", "mtime").where(F.col("mtime").isNotNull())
        done = store.apply(root, fresh, void, listing, model, make().dim, started, name)
        stats |= {"chunks_written": done["written"], "total_chunks": done["total"]}
        files.unpersist()
    stats["seconds"] = round(time.time() - started, 2)
    disk.unpersist()
    gone.unpersist()
    return stats


def auto_reindex(store: Store, force: bool = False, make: Callable[[], Provider] = HashingProvider, at_once: int = 4) -> list[str]:
    """One line per registered project, after bringing it up to date; folders that are gone are skipped.

    ``at_once`` projects are under way at a time, so that small ones share the cluster.
    """

    def one(path: str) -> str:
        if not os.path.isdir(path):
            return f"SKIP {path} (directory gone)"
        s = index_repository(store, path, force, make=make)
        changed = s["files_changed"] or s["orphan_files"]
        return f"{path}: {s['files_changed']} files, {s['orphan_chunks_purged']} purged" if changed else f"{path}: up to date"

    paths = [r["path"] for r in store.projects().orderBy("path").collect()]  # the registry, not the data
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(one, paths))
