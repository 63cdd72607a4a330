"""Projects: which one a file lies in, listing, upserts, incremental plans and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project_of(files: DataFrame, projects: DataFrame, path_col: str = "file_path") -> DataFrame:
    """``files`` with ``project``: the longest project path that the file lies below, else null.

    Joins on equal path prefixes, so no file meets a project it does not lie in, and characters
    such as ``_`` in a path are literal.
    """
    parts = F.split(F.col(path_col), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    known = projects.select(F.col("path").alias("__path")).distinct()
    hit = files.select(path_col).distinct().select(path_col, F.explode(prefixes).alias("__path")).join(known, "__path")
    best = hit.groupBy(path_col).agg(F.max_by("__path", F.length("__path")).alias("project"))
    return files.join(best, path_col, "left")


def list_projects(projects: DataFrame) -> DataFrame:
    """Projects with text timestamps, latest first and those never indexed last."""
    when = F.date_format("last_indexed", "yyyy-MM-dd'T'HH:mm:ss")
    return projects.orderBy(F.desc_nulls_last("last_indexed"), "id").select(
        "id", "path", F.coalesce(F.try_element_at("metadata", F.lit("name")), F.substring_index("path", "/", -1)).alias("name"), when.alias("last_indexed"), F.coalesce("total_chunks", F.lit(0)).alias("total_chunks")
    )


def by_path(projects: DataFrame, paths: DataFrame) -> DataFrame:
    """``(path, total_chunks, known)`` of each wanted ``path``, compared exactly; 0 chunks where it is unknown."""
    known = projects.select(F.col("path").alias("__path"), "total_chunks", F.lit(True).alias("known"))
    hit = paths.select("path").join(known, F.col("path") == F.col("__path"), "left")
    return hit.select("path", F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"), F.coalesce("known", F.lit(False)).alias("known"))


def upsert_projects(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` merged with ``new (path, name)`` on the path: a known project only gets the new name.

    Counts and timestamps of known projects stay; unknown paths come in with neither. Repeated
    new paths count once, with the greatest name.
    """
    n = new.groupBy("path").agg(F.max("name").alias("__name"))
    both = old.join(n, "path", "full_outer")
    name = F.coalesce("__name", F.try_element_at("metadata", F.lit("name")))
    return both.select("path", "last_indexed", F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"), name.alias("name"))


def on_disk(files: DataFrame) -> DataFrame:
    """One row per path, with its latest modification; null where that is unknown."""
    return files.groupBy("path").agg(F.max("mtime").alias("mtime"))


def changed_files(files: DataFrame, projects: DataFrame) -> DataFrame:
    """``(path, project)`` of files to index again: newer than the project's last run, or of unknown age.

    Files of a project that was never indexed all count; files outside every project don't.
    """
    f = project_of(on_disk(files), projects, "path").where("project is not null")
    p = projects.select(F.col("path").alias("project"), "last_indexed")
    return f.join(p, "project").where(F.col("last_indexed").isNull() | F.col("mtime").isNull() | (F.col("mtime") > F.col("last_indexed"))).select("path", "project")


def incremental_plan(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(path, state)``: new, changed, deleted or same, from disk and index.

    A file is changed if its modification is newer than that of its chunks, or unknown.
    """
    disk = on_disk(files).select("path", "mtime", F.lit(1).alias("d"))
    index = chunks.groupBy(F.col("file_path").alias("path")).agg(F.max("mtime").alias("known"), F.lit(1).alias("x"))
    both = disk.join(index, "path", "full_outer")
    state = F.when(F.col("x").isNull(), "new").when(F.col("d").isNull(), "deleted").when(F.col("mtime").isNull() | F.col("known").isNull() | (F.col("mtime") > F.col("known")), "changed").otherwise("same")
    return both.select("path", state.alias("state"))


def reindex_report(files: DataFrame, chunks: DataFrame, projects: DataFrame) -> DataFrame:
    """One row per project: numbers of new, changed and deleted files, and a line to print."""
    plan = project_of(incremental_plan(files, chunks), projects, "path").where("project is not null")
    count = lambda s: F.count(F.when(F.col("state") == s, 1))
    n = plan.groupBy("project").agg(count("new").alias("n_new"), count("changed").alias("n_changed"), count("deleted").alias("n_deleted"))
    out = projects.select(F.col("path").alias("project")).join(n, "project", "left").na.fill(0, ["n_new", "n_changed", "n_deleted"])
    todo = F.col("n_new") + F.col("n_changed")
    report = F.when((todo > 0) | (F.col("n_deleted") > 0), F.format_string("%d files, %d purged", todo, F.col("n_deleted"))).otherwise("up to date")
    return out.select("project", "n_new", "n_changed", "n_deleted", report.alias("report"))
