"""A versioned Parquet table of chunks, in layers per repository.

A run adds a layer: the chunks of the files that changed, the paths whose older chunks no longer
count, and the listing it saw. What a run writes is in proportion to what changed; after
``MAX_LAYERS`` the layers of a repository are merged into one. A small manifest names the layers.
Every version of it is a new file that gets its name only when it and all it names are written, and
of two writers of one version only one succeeds, on any file system that refuses to rename onto an
existing file. Readers resolve the manifest once per query, so they see one version.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode import schema
from codelode.functions import text as X
from codelode.sources.fs import Folder

COLUMNS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.CHUNKS)
LISTING = "path string, mtime timestamp"
#: Layers of a repository before they are merged, versions of the manifest that are kept, attempts to commit.
MAX_LAYERS, KEPT_VERSIONS, ATTEMPTS = 8, 10, 20


def repo_id(path: str) -> str:
    return hashlib.md5(path.encode()).hexdigest()[:16]


class Store:
    """Chunks and projects below one folder that all executors see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)

    # -- manifest

    def _versions(self) -> list[int]:
        return sorted(int(m[1]) for m in (re.fullmatch(r"manifest-(\d+)\.json", n) for n in self.folder.names()) if m)

    def manifest(self) -> dict:
        """The newest version."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "dim": None, "model": None, "repos": {}, "projects": {}}
        return json.loads(self.folder.read(f"manifest-{versions[-1]:010d}.json"))

    def _commit(self, repo_path: str, before: dict, change: Callable[[dict], None]) -> None:
        """Makes ``change`` to the newest manifest; a change to the same repository meanwhile is an error."""
        for _ in range(ATTEMPTS):
            now = self.manifest()
            if now["repos"].get(repo_path) != before["repos"].get(repo_path):
                raise RuntimeError("the repository changed meanwhile; run again")
            change(now)
            now["version"] += 1
            if self.folder.create(f"manifest-{now['version']:010d}.json", json.dumps(now)):
                for old in self._versions()[:-KEPT_VERSIONS]:
                    self.folder.delete(f"manifest-{old:010d}.json")
                return
        raise RuntimeError("too many writers; run again")

    # -- chunks

    def _layers(self, repo_path: str | None, manifest: dict) -> list[dict]:
        """Layers of the repositories that hold files at or below a path, or that the path lies in."""
        inside = lambda a, b: a == b or a.startswith(b.rstrip("/") + "/")
        return [x for p, layers in manifest["repos"].items() if repo_path is None or inside(p, repo_path) or inside(repo_path, p) for x in layers]

    def chunks(self, repo_path: str | None = None) -> DataFrame:
        """The chunks at or below a path, or all, as of now; other repositories are not scanned."""
        out = self._visible(self._layers(repo_path, self.manifest())).drop("layer")
        whole = repo_path is None or repo_path in self.manifest()["repos"]
        return out if whole else out.where(X.under(F.col("file_path"), repo_path))

    def _visible(self, layers: list[dict]) -> DataFrame:
        if not layers:
            return self.spark.createDataFrame([], COLUMNS + ", layer bigint")
        data = self.spark.read.schema(COLUMNS + ", layer bigint").parquet(*[self.folder.at(x["data"]) for x in layers])
        drops = [self.folder.at(x["dropped"]) for x in layers if x["dropped"]]
        if not drops:
            return data
        gone = self.spark.read.schema("file_path string, layer bigint").parquet(*drops).groupBy("file_path").agg(F.max("layer").alias("__upto"))
        return data.join(gone.withColumnRenamed("file_path", "__path"), (F.col("file_path") == F.col("__path")) & (F.col("layer") < F.col("__upto")), "left_anti")

    def seen(self, repo_path: str) -> DataFrame:
        """``(path, mtime)`` of the files that the last run looked at, those without a chunk included."""
        layers = self.manifest()["repos"].get(repo_path)
        if not layers or not layers[-1]["files"]:
            return self.spark.createDataFrame([], LISTING)
        return self.spark.read.schema(LISTING).parquet(self.folder.at(layers[-1]["files"]))

    def apply(self, repo_path: str, fresh: DataFrame, dropped: DataFrame | None, seen: DataFrame | None = None, model: str | None = None, dim: int | None = None, started: float | None = None, name: str | None = None) -> dict:
        """Adds ``fresh`` chunks and voids the older ones of the files ``dropped (file_path)``.

        With ``dropped=None`` all older chunks are void. Returns ``{written, total}``. A dimension
        other than the table's is an error. ``started`` becomes the project's ``last_indexed``, so
        that edits during the run are seen by the next one.
        """
        old = self.manifest()
        if old["dim"] and dim and old["dim"] != dim:
            raise ValueError(f"the table holds vectors of {old['dim']} values, not {dim}")
        layers = [] if dropped is None else old["repos"].get(repo_path, [])
        number = max([x["number"] for x in old["repos"].get(repo_path, [])], default=0) + 1
        base = f"data/repo_id={repo_id(repo_path)}/v={number}-{uuid.uuid4().hex[:8]}"
        layer = {"number": number, "data": f"{base}/chunks", "dropped": None, "files": f"{base}/files"}
        keep = self._visible(layers)
        if len(layers) >= MAX_LAYERS:  # merged into the new layer
            rest = keep.join(dropped.select("file_path").distinct(), "file_path", "left_anti")
            fresh, layers, keep = rest.drop("layer").select(*fresh.columns).unionByName(fresh), [], self._visible([])
        fresh.withColumn("layer", F.lit(number).cast("bigint")).sortWithinPartitions("file_path", "start_line").write.parquet(self.folder.at(layer["data"]))
        (self.seen(repo_path) if seen is None else seen).write.parquet(self.folder.at(layer["files"]))
        if layers:
            layer["dropped"] = f"{base}/dropped"
            dropped.select("file_path").distinct().withColumn("layer", F.lit(number).cast("bigint")).write.parquet(self.folder.at(layer["dropped"]))
        written = self._visible([{**layer, "dropped": None}]).count()
        total = self._visible([*layers, layer]).count() if layers else written

        def change(m: dict) -> None:
            m["repos"][repo_path] = [*layers, layer]
            m["dim"], m["model"] = dim or m["dim"], model or m["model"]
            before = m["projects"].get(repo_path, {})
            m["projects"][repo_path] = {"name": name or before.get("name") or os.path.basename(repo_path), "last_indexed": started if started is not None else time.time(), "total_chunks": total}

        self._commit(repo_path, old, change)
        return {"written": written, "total": total}

    def replace(self, repo_path: str, chunks: DataFrame, model: str | None = None, dim: int | None = None, started: float | None = None, name: str | None = None, seen: DataFrame | None = None) -> int:
        """Makes ``chunks`` the repository's whole content; returns how many were written."""
        return self.apply(repo_path, chunks, None, seen, model, dim, started, name)["written"]

    def upsert(self, repo_path: str, chunks: DataFrame) -> dict:
        """Rows by their natural key ``(file_path, symbol, start_line)``: known keys are updated, others added.

        Nulls in a key are equal to each other; of repeated new rows the latest counts. The files
        that the rows belong to are written again, with their other chunks; the rest isn't touched.
        """
        from codelode.operators.search import merge_latest

        cols = [f.name for f in schema.CHUNKS]
        paths = chunks.select("file_path").distinct()
        now = self.chunks(repo_path).join(paths, "file_path", "left_semi").select(*cols, F.lit(0).alias("__new"))
        new = merge_latest(chunks.select(*cols)).withColumn("__new", F.lit(1))
        merged = merge_latest(now.unionByName(new), newest="__new").drop("__new")
        return self.apply(repo_path, merged, paths, started=self.manifest()["projects"].get(repo_path, {}).get("last_indexed"))

    def delete_files(self, repo_path: str, paths: DataFrame) -> int:
        """Drops the chunks of the files ``(file_path)``; returns how many. An empty list writes nothing."""
        if paths.isEmpty():
            return 0
        now = self.chunks(repo_path)
        before = now.count()
        last = self.manifest()["projects"].get(repo_path, {}).get("last_indexed")
        seen = self.seen(repo_path).join(paths.select(F.col("file_path").alias("path")).distinct(), "path", "left_anti")
        return before - self.apply(repo_path, now.limit(0), paths, seen, started=last)["total"]

    def remove(self, repo_path: str) -> int:
        """Drops a repository and its project; returns its number of chunks."""
        old = self.manifest()
        n = self._visible(old["repos"].get(repo_path, [])).count()

        def change(m: dict) -> None:
            m["repos"].pop(repo_path, None)
            m["projects"].pop(repo_path, None)

        self._commit(repo_path, old, change)
        return n

    # -- projects

    def upsert_project(self, repo_path: str, name: str | None = None) -> dict:
        """Registers a project or renames it; returns what was known before."""
        old = self.manifest()
        before = old["projects"].get(repo_path, {"last_indexed": None, "total_chunks": 0})

        def change(m: dict) -> None:
            m["projects"][repo_path] = {**before, **m["projects"].get(repo_path, {}), "name": name or before.get("name") or os.path.basename(repo_path)}

        probe = json.loads(json.dumps(old))
        change(probe)
        if probe != old:
            self._commit(repo_path, old, change)
        return before

    def projects(self) -> DataFrame:
        """The registry with the schema of the project table."""
        rows = [(k, p, v["last_indexed"], v.get("total_chunks") or 0, {"name": v.get("name") or ""}) for k, (p, v) in enumerate(sorted(self.manifest()["projects"].items()), 1)]
        df = self.spark.createDataFrame(rows, "id int, path string, t double, total_chunks int, metadata map<string,string>")
        return df.select("id", "path", F.timestamp_seconds("t").alias("last_indexed"), "total_chunks", "metadata") if rows else self.spark.createDataFrame([], schema.PROJECTS)
