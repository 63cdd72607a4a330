"""A Python data source that lists and reads the files of a source tree.

``spark.read.format("repo_files").option("path", root).load()`` gives ``(path, mtime, length,
language, content)``. The driver looks into the upper folders only; the rest of the walk runs in the
tasks. Hidden directories and those on the skip list are pruned while walking;
files whose names start with a dot or an underscore are kept, other than by Spark's own listing.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codelode import schema

_DDL = "path string, mtime timestamp, length bigint, language string, content string"


def walk(root: str, extensions: dict[str, str] | None = None, skip: tuple[str, ...] = schema.SKIP_DIRS) -> Iterator[str]:
    """Paths of supported files below ``root``, in order; suffixes are case-sensitive, links not followed."""
    known = schema.EXTENSIONS if extensions is None else extensions
    for folder, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in skip and not d.startswith("."))
        for name in sorted(files):
            if os.path.splitext(name)[1] in known:
                yield os.path.join(folder, name)


def read_text(path: str) -> str | None:
    """The text of a file, bad bytes replaced and line ends as LF; None if it can't be read."""
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


class Files(InputPartition):
    """Given files, or all below given folders."""

    def __init__(self, paths: list[str], trees: list[str]):
        super().__init__(None)
        self.paths, self.trees = paths, trees

    def __iter__(self) -> Iterator[str]:
        yield from self.paths
        for tree in self.trees:
            yield from walk(tree)


def split_walk(root: str, trees: int) -> tuple[list[str], list[str]]:
    """(files, folders): the upper part of the walk, until at least ``trees`` folders are left to be walked, or none."""
    files: list[str] = []
    todo = [root]
    while todo and len(todo) < trees:
        below: list[str] = []
        for at in todo:
            folder, dirs, names = next(os.walk(at), (at, [], []))
            files += [os.path.join(folder, n) for n in sorted(names) if os.path.splitext(n)[1] in schema.EXTENSIONS]
            below += [p for d in sorted(dirs) if d not in schema.SKIP_DIRS and not d.startswith(".") and not os.path.islink(p := os.path.join(folder, d))]
        todo = below
    return files, todo


class RepoReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.root = os.path.realpath(options["path"])
        self.per = int(options.get("filesperpartition", "200"))
        self.trees = int(options.get("trees", "64"))
        self.with_content = options.get("content", "true").lower() != "false"
        self.columns = columns

    def partitions(self):
        paths, trees = split_walk(self.root, self.trees)
        # folders that no task has looked into yet may differ in size, so several go to a task at most
        groups = [trees[k :: 2 * self.trees] for k in range(min(len(trees), 2 * self.trees))]
        return [Files(paths[k : k + self.per], []) for k in range(0, len(paths), self.per)] + [Files([], g) for g in groups] or [Files([], [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        paths = iter(partition)
        while some := list(islice(paths, self.per)):
            yield self._batch(some)

    def _batch(self, paths: list[str]) -> pa.RecordBatch:
        rows = []
        for p in paths:
            try:
                st = os.stat(p)
                mtime, size = datetime.fromtimestamp(st.st_mtime, timezone.utc), st.st_size
            except OSError:
                mtime, size = None, None
            rows.append((p, mtime, size, schema.EXTENSIONS[os.path.splitext(p)[1]], read_text(p) if self.with_content else None))
        cols = list(zip(*rows, strict=True))
        kinds = [pa.string(), pa.timestamp("us", tz="UTC"), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "mtime", "length", "language", "content"])


class RepoFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return _DDL

    def reader(self, schema):  # noqa: A002 - name given by the interface
        return RepoReader(self.options, [f.name for f in schema.fields])


def read_files(files: DataFrame) -> DataFrame:
    """The files ``(path, mtime, length, language)`` with their content; null where one can't be read.

    Every task opens the paths it was given, so only these are read. Paths are dealt out first,
    as a listing of many small rows may sit in one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):  # bounds the text in memory
                part = batch.slice(lo, 64)
                texts = pa.array([read_text(p) for p in part.column(0).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=["path", "mtime", "length", "language", "content"])

    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "mtime", "length", "language").repartition(4 * cores, "path").mapInArrow(run, _DDL)


def repo_files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """The files below ``root``; a folder that doesn't exist is a ValueError."""
    if not os.path.isdir(root):
        raise ValueError(f"not a directory: {root}")
    spark.dataSource.register(RepoFiles)
    return spark.read.format("repo_files").option("path", root).option("content", str(content).lower()).load()
