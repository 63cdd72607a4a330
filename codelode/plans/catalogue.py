"""The named queries of the engine, each over its whole tables, and their SQL for a second engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode import schema
from codelode.functions import text as X
from codelode.functions import vector as V
from codelode.operators import chunking, projects, quality, search
from codelode.operators.embed import HashingProvider, embed
from codelode.plans import samples
from codelode.session import cut_lineage, ensure_checkpoint_dir, table
from codelode.sources.fs import Folder
from codelode.streaming import incremental

DIM = 64
REPO = "/srv/repos/my_repo"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_chunks")


def example_vector(spark: SparkSession, d: str) -> tuple[list[float], str]:
    """Vector and file of the searchable chunk with the smallest id: one row reaches the driver."""
    row = chunks(spark, d).where(V.searchable(F.col("embedding"), DIM)).select("id", "file_path", "embedding").orderBy("id").limit(1).collect()
    return ([float(x) for x in row[0]["embedding"]], row[0]["file_path"]) if row else ([], "")


# ---------------------------------------------------------------- SQL parts

_OK = f"embedding IS NOT NULL AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_Q = f"q AS (SELECT embedding::DOUBLE[] AS qv, file_path AS qf FROM code_chunks WHERE {_OK} ORDER BY id LIMIT 1)"
_SCORE = "list_inner_product(c.embedding::DOUBLE[], q.qv) / (sqrt(list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) * sqrt(list_inner_product(q.qv, q.qv)))"
_HIT = "id, file_path, language, symbol, start_line, end_line"


def _topk_sql(where: str = "true", k: int = 10, low: float | None = None) -> str:
    extra = "" if low is None else f" WHERE s >= {low}"
    return f"WITH {_Q}, h AS (SELECT c.*, {_SCORE} AS s FROM code_chunks c, q WHERE {_OK.replace('embedding', 'c.embedding')} AND {where}) SELECT {_HIT}, content, summary, metadata['type'] AS kind, round(s, 4) + 0.0 AS score FROM h{extra} ORDER BY round(s, 9) DESC, id LIMIT {k}"


_PROJECT_SQL = "(SELECT max_by(p.path, length(p.path)) FROM projects p WHERE starts_with({0}, p.path || '/'))"


# ---------------------------------------------------------------- retrieval


def _found(spark, d, k=10, low=None, **filters) -> DataFrame:
    """Hits for the example vector with their texts; of the metadata, the one key that is always written."""
    c = chunks(spark, d)
    hits = search.semantic_search(c, example_vector(spark, d)[0], k, min_score=low, **filters)
    return search.with_details(hits, c).withColumn("kind", F.try_element_at("metadata", F.lit("type"))).drop("metadata")


@query(_topk_sql())
def semantic_topk(spark, d):
    return _found(spark, d)


@query(_topk_sql(k=50, low=0.85))
def semantic_topk_min_score(spark, d):
    return _found(spark, d, 50, 0.85)


@query(_topk_sql("c.language = 'python'"))
def semantic_topk_language(spark, d):
    return _found(spark, d, language="python")


@query(_topk_sql("c.file_path LIKE '%/core/%'"))
def semantic_topk_file_pattern(spark, d):
    return _found(spark, d, file_pattern="%/core/%")


@query(_topk_sql(f"starts_with(c.file_path, '{REPO}/')"))
def semantic_topk_repo(spark, d):
    return _found(spark, d, repo_path=REPO + "/")


@query(_topk_sql(f"c.language = 'python' AND c.file_path LIKE '%.py' AND starts_with(c.file_path, '{REPO}/')", low=0.3))
def semantic_topk_all_filters(spark, d):
    return _found(spark, d, low=0.3, language="python", file_pattern="%.py", repo_path=REPO)


@query(_topk_sql("c.file_path <> q.qf", 5))
def related_chunks(spark, d):
    v, path = example_vector(spark, d)
    c = chunks(spark, d)
    return search.with_details(search.related_chunks(c, v, path), c).withColumn("kind", F.try_element_at("metadata", F.lit("type"))).drop("metadata")


@query(f"WITH {_Q} SELECT {_HIT} FROM code_chunks, q WHERE file_path = q.qf")
def file_chunks(spark, d):
    return search.file_chunks(chunks(spark, d), example_vector(spark, d)[1])


@query(
    f"WITH {_Q}, h AS (SELECT c.*, {_SCORE} AS s FROM code_chunks c, q WHERE {_OK.replace('embedding', 'c.embedding')} AND c.file_path <> q.qf ORDER BY round(s, 9) DESC, id LIMIT 5) "
    f"SELECT 'chunk' AS kind, CAST(row_number() OVER (ORDER BY start_line NULLS LAST, id) AS INTEGER) AS position, {_HIT}, CAST(NULL AS DOUBLE) AS score FROM code_chunks, q WHERE file_path = q.qf "
    f"UNION ALL SELECT 'related', CAST(row_number() OVER (ORDER BY round(s, 4) DESC, id) AS INTEGER), {_HIT}, round(s, 4) + 0.0 FROM h"
)
def file_context(spark, d):
    v, path = example_vector(spark, d)
    return search.file_context(chunks(spark, d), path, v)


_BATCH = f"""e AS (SELECT id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM code_chunks WHERE {_OK}),
s AS (SELECT a.id AS query_id, b.id AS chunk_id, round(list_inner_product(a.v, b.v) / (a.n * b.n), 9) AS s FROM e a, e b WHERE a.id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS INTEGER) AS rank FROM s)"""


@query(f"WITH {_BATCH} SELECT query_id, chunk_id, round(s, 4) + 0.0 AS score, rank FROM r WHERE rank <= 10")
def multi_query_topk(spark, d):
    """Queries are all rows whose id is divisible by 50, against all rows."""
    c = chunks(spark, d)
    return search.batch_search(c, c.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding"))


@query(f"WITH {_Q} SELECT id, round(list_inner_product(c.embedding::DOUBLE[], q.qv) / (sqrt(list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) * sqrt(list_inner_product(q.qv, q.qv)) + 1e-10), 4) + 0.0 AS score FROM code_chunks c, q WHERE len(c.embedding) = {DIM} AND len(list_filter(c.embedding, lambda x: isnan(x))) = 0")
def cosine_eps(spark, d):
    q = V.vector(example_vector(spark, d)[0])
    v = F.col("embedding")
    return chunks(spark, d).where(V.has_dim(v, DIM) & ~V.has_nan(v)).select("id", F.round(V.cosine_with_epsilon(v, q), 4).alias("score"))


@query(f"SELECT id, round(list_extract(v, 1) / n, 4) + 0.0 AS first, round(list_extract(v, {DIM}) / n, 4) + 0.0 AS last, round(list_sum(list_transform(v, lambda x: x / n)), 4) + 0.0 AS total FROM (SELECT id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM code_chunks WHERE {_OK})")
def l2_normalize(spark, d):
    u = chunks(spark, d).where(V.searchable(F.col("embedding"), DIM)).select("id", V.l2_normalize(F.col("embedding")).alias("u"))
    return u.select("id", F.round(F.element_at("u", 1), 4).alias("first"), F.round(F.element_at("u", DIM), 4).alias("last"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(f"SELECT CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> {DIM} THEN 'wrong_dimension' WHEN len(list_filter(embedding, lambda x: isnan(x))) > 0 THEN 'nan' WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'zero' ELSE 'ok' END AS state, count(*) AS n FROM code_chunks GROUP BY 1")
def embedding_validity(spark, d):
    return chunks(spark, d).groupBy(V.validity(F.col("embedding"), DIM).alias("state")).agg(F.count("*").alias("n"))


@query(f"SELECT id, round(1 - list_inner_product(c.embedding::DOUBLE[], q.qv) / (sqrt(list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) * sqrt(list_inner_product(q.qv, q.qv))), 4) + 0.0 AS distance FROM code_chunks c, q WHERE {_OK.replace('embedding', 'c.embedding')}".replace("SELECT id", f"WITH {_Q} SELECT id", 1))
def cosine_distances(spark, d):
    q = V.vector(example_vector(spark, d)[0])
    usable = chunks(spark, d).where(V.searchable(F.col("embedding"), DIM))
    return usable.select("id", F.round(V.cosine_distance(F.col("embedding"), q), 4).alias("distance"))


@query(f"SELECT {_HIT}, 0.0 AS score FROM code_chunks WHERE false")
def semantic_zero_vector(spark, d):
    """A query without a direction, made by the zero vector, finds nothing."""
    zero = spark.range(1).select(V.zero_vector(DIM).alias("v")).collect()[0]["v"]
    return search.semantic_search(chunks(spark, d), zero)


_LINES25 = "string_split(content, chr(10))"


@query(
    f"WITH {_Q}, h AS (SELECT c.*, {_SCORE} AS s FROM code_chunks c, q WHERE {_OK.replace('embedding', 'c.embedding')} ORDER BY round(s, 9) DESC, id LIMIT 10) "
    f"SELECT id, printf('%s:%s-%s %s (%.3f)', file_path, coalesce(CAST(start_line AS VARCHAR), '?'), coalesce(CAST(end_line AS VARCHAR), '?'), coalesce(symbol, ''), CAST(round(CAST(round(s, 4) AS DECIMAL(10, 4)), 3) AS DOUBLE)) || chr(10) || array_to_string(list_slice({_LINES25}, 1, 25), chr(10)) "
    f"|| CASE WHEN len({_LINES25}) > 25 THEN printf('%s... (%d more lines)', chr(10), len({_LINES25}) - 25) ELSE '' END AS rendered FROM h"
)
def rendered_hits(spark, d):
    """Hits as text: a head line and the first 25 lines."""
    return search.rendered(_found(spark, d), F.col("content"), 25).select("id", "rendered")


# ---------------------------------------------------------------- statistics and listings


@query("SELECT count(*) AS total_chunks, count(DISTINCT file_path) AS total_files, count(DISTINCT language) AS total_languages FROM code_chunks")
def index_stats(spark, d):
    return search.stats(chunks(spark, d))


@query(f"SELECT count(*) AS total_chunks, count(DISTINCT file_path) AS total_files, count(DISTINCT language) AS total_languages FROM code_chunks WHERE starts_with(file_path, '{REPO}/')")
def index_stats_repo(spark, d):
    return search.stats(chunks(spark, d), REPO)


@query("SELECT id, path, coalesce(metadata['name'], split_part(path, '/', -1)) AS name, strftime(last_indexed, '%Y-%m-%dT%H:%M:%S') AS last_indexed, coalesce(total_chunks, 0) AS total_chunks, CAST(row_number() OVER (ORDER BY projects.last_indexed DESC NULLS LAST, id) AS INTEGER) AS position FROM projects")
def list_projects(spark, d):
    """The listing with each project's place in it; the registry is small."""
    order = Window.orderBy(F.desc_nulls_last("last_indexed"), "id")
    return projects.list_projects(table(spark, d, "projects")).withColumn("position", F.row_number().over(order))


@query("SELECT DISTINCT file_path FROM code_chunks")
def distinct_files(spark, d):
    return chunks(spark, d).select("file_path").distinct()


@query(f"SELECT f.project, count(*) AS n_files, CAST(sum(f.n) AS BIGINT) AS n_chunks FROM (SELECT file_path, count(*) AS n, {_PROJECT_SQL.format('file_path')} AS project FROM code_chunks GROUP BY file_path) f GROUP BY f.project")
def project_sizes(spark, d):
    files = chunks(spark, d).groupBy("file_path").agg(F.count("*").alias("n"))
    return projects.project_of(files, table(spark, d, "projects")).groupBy("project").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_chunks"))


@query("SELECT language, CAST(sum(length(content) // 4) AS BIGINT) AS tokens, count(*) AS n FROM code_chunks GROUP BY language")
def token_estimate(spark, d):
    return chunks(spark, d).groupBy("language").agg(F.sum(X.approx_tokens(F.col("content"))).alias("tokens"), F.count("*").alias("n"))


_EXT_VALUES = ", ".join(f"('{e}', '{lang}')" for e, lang in schema.EXTENSIONS.items())


@query(f"WITH x(ext, language) AS (VALUES {_EXT_VALUES}), f AS (SELECT DISTINCT file_path, regexp_extract(split_part(file_path, '/', -1), '[^/.][^/]*(\\.[^./]+)$', 1) AS suffix FROM code_chunks) SELECT f.suffix, x.language, count(*) AS n_files FROM f LEFT JOIN x ON f.suffix = x.ext GROUP BY 1, 2")
def ext_language_lookup(spark, d):
    files = chunks(spark, d).select("file_path").distinct().select(X.suffix(F.col("file_path")).alias("suffix"), X.language_of(F.col("file_path")).alias("language"))
    return files.groupBy("suffix", "language").agg(F.count("*").alias("n_files"))


@query("SELECT metadata['type'] AS kind, metadata['model'] AS model, count(*) AS n FROM code_chunks GROUP BY 1, 2")
def metadata_kinds(spark, d):
    m = F.col("metadata")
    return chunks(spark, d).groupBy(F.try_element_at(m, F.lit("type")).alias("kind"), F.try_element_at(m, F.lit("model")).alias("model")).agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY event_type")
def metadata_json(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"), F.count("*").alias("n"))


@query("SELECT id, array_to_string(list_slice(string_split(content, chr(10)), 1, 25), chr(10)) AS head, CAST(greatest(len(string_split(content, chr(10))) - 25, 0) AS INTEGER) AS more_lines FROM code_chunks")
def preview_25_lines(spark, d):
    p = X.preview(F.col("content"), 25)
    return chunks(spark, d).select("id", p["head"].alias("head"), p["more_lines"].alias("more_lines"))


_WHITE = "\\t\\n\\x{0b}\\x{0c}\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


@query(f"SELECT doc_id, substr(text, 1, 50) AS head, CAST(length(regexp_replace(text, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')) AS INTEGER) AS n_stripped, NOT regexp_matches(text, '[^{_WHITE}]') AS blank, CAST(length(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS INTEGER) AS n_unix FROM documents")
def text_functions(spark, d):
    """Cutting, stripping, blankness and line ends of every document."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.truncate(t, 50).alias("head"), F.length(X.strip(t)).alias("n_stripped"), X.is_blank(t).alias("blank"), F.length(X.unix_lines(t)).alias("n_unix"))


@query("SELECT q.path, coalesce(p.total_chunks, 0) AS total_chunks, p.path IS NOT NULL AS known FROM (SELECT path FROM projects UNION ALL SELECT '/srv/repos/nowhere') q LEFT JOIN projects p ON p.path = q.path")
def project_lookup(spark, d):
    """Projects by their exact path; unknown ones have no chunks. Asked for: all, and one that isn't there."""
    p = table(spark, d, "projects")
    wanted = p.select("path").union(spark.createDataFrame([("/srv/repos/nowhere",)], "path string"))
    return projects.by_path(p, wanted)


# ---------------------------------------------------------------- maintenance


_DISK = "disk AS (SELECT path, max(mtime) AS mtime FROM source_files GROUP BY path)"


@query("SELECT DISTINCT file_path FROM code_chunks WHERE file_path NOT IN (SELECT path FROM source_files)")
def orphan_files(spark, d):
    disk = table(spark, d, "source_files").select(F.col("path").alias("file_path"))
    return chunks(spark, d).select("file_path").distinct().join(disk, "file_path", "left_anti")


@query("SELECT id FROM code_chunks WHERE file_path IN (SELECT path FROM source_files)")
def delete_file_chunks(spark, d):
    """Rows that stay when the chunks of all files missing on disk are dropped."""
    return chunks(spark, d).join(orphan_files(spark, d), "file_path", "left_anti").select("id")


@query(f"SELECT id FROM code_chunks WHERE NOT starts_with(file_path, '{REPO}/')")
def remove_repository(spark, d):
    """Rows that stay when one repository is removed."""
    return chunks(spark, d).where(~X.under(F.col("file_path"), REPO)).select("id")


@query("WITH n AS (SELECT path, max(name) AS name FROM (SELECT path, 'renamed' AS name FROM projects WHERE total_chunks IS NULL UNION ALL SELECT '/srv/repos/brand-new', 'brand-new') GROUP BY path) SELECT coalesce(p.path, n.path) AS path, p.last_indexed, coalesce(p.total_chunks, 0) AS total_chunks, coalesce(n.name, p.metadata['name']) AS name FROM projects p FULL JOIN n ON p.path = n.path")
def upsert_projects(spark, d):
    p = table(spark, d, "projects")
    new = p.where("total_chunks is null").select("path", F.lit("renamed").alias("name")).union(spark.createDataFrame([("/srv/repos/brand-new", "brand-new")], "path string, name string"))
    return projects.upsert_projects(p, new)


@query("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY file_path, symbol, start_line ORDER BY created_at DESC NULLS LAST, id DESC) AS rn FROM code_chunks) WHERE rn = 1")
def upsert_chunks(spark, d):
    return search.merge_latest(chunks(spark, d).select("id", "file_path", "symbol", "start_line", "created_at")).select("id")


@query(f"WITH {_DISK}, f AS (SELECT path, mtime, {_PROJECT_SQL.format('disk.path')} AS project FROM disk) SELECT f.path, f.project FROM f JOIN projects p ON p.path = f.project WHERE p.last_indexed IS NULL OR f.mtime IS NULL OR f.mtime > p.last_indexed")
def changed_files(spark, d):
    return projects.changed_files(table(spark, d, "source_files"), table(spark, d, "projects"))


_PLAN = f"{_DISK}, x AS (SELECT file_path AS path, max(mtime) AS known FROM code_chunks GROUP BY file_path), plan AS (SELECT coalesce(disk.path, x.path) AS path, CASE WHEN x.path IS NULL THEN 'new' WHEN disk.path IS NULL THEN 'deleted' WHEN disk.mtime IS NULL OR x.known IS NULL OR disk.mtime > x.known THEN 'changed' ELSE 'same' END AS state FROM disk FULL JOIN x ON disk.path = x.path)"


@query(f"WITH {_PLAN} SELECT path, state FROM plan")
def incremental_plan(spark, d):
    return projects.incremental_plan(table(spark, d, "source_files"), chunks(spark, d))


@query(
    f"WITH {_PLAN}, s AS (SELECT {_PROJECT_SQL.format('plan.path')} AS project, state FROM plan), n AS (SELECT project, count(*) FILTER (state = 'new') AS n_new, count(*) FILTER (state = 'changed') AS n_changed, count(*) FILTER (state = 'deleted') AS n_deleted FROM s GROUP BY project) "
    "SELECT p.path AS project, coalesce(n_new, 0) AS n_new, coalesce(n_changed, 0) AS n_changed, coalesce(n_deleted, 0) AS n_deleted, CASE WHEN coalesce(n_new + n_changed + n_deleted, 0) > 0 THEN (n_new + n_changed) || ' files, ' || n_deleted || ' purged' ELSE 'up to date' END AS report FROM projects p LEFT JOIN n ON n.project = p.path"
)
def reindex_report(spark, d):
    return projects.reindex_report(table(spark, d, "source_files"), chunks(spark, d), table(spark, d, "projects"))


# ---------------------------------------------------------------- chunking

_FOLD = """t AS (SELECT doc_id, lang, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE regexp_matches(text, '[^\\s\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{3000}]')),
f(doc_id, lang, ls, i, st, n, cut_s, cut_e) AS (
  SELECT doc_id, lang, ls, 0, 1, -1, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER) FROM t
  UNION ALL
  SELECT doc_id, lang, ls, i + 1,
    CASE WHEN n + 1 + length(ls[i + 1]) >= 2000 THEN i + 2 ELSE st END,
    CASE WHEN n + 1 + length(ls[i + 1]) >= 2000 THEN -1 ELSE n + 1 + length(ls[i + 1]) END,
    CASE WHEN n + 1 + length(ls[i + 1]) >= 2000 THEN st END,
    CASE WHEN n + 1 + length(ls[i + 1]) >= 2000 THEN i + 1 END
  FROM f WHERE i < len(ls)),
c AS (SELECT doc_id, lang, ls, cut_s AS s, cut_e AS e FROM f WHERE cut_s IS NOT NULL UNION ALL SELECT doc_id, lang, ls, st, i FROM f WHERE i = len(ls) AND n >= 100),
k AS (SELECT doc_id, lang, '<block_' || s || '>' AS symbol, array_to_string(list_slice(ls, s, e), chr(10)) AS content, CAST(s AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line FROM c)"""


@query(f"WITH RECURSIVE {_FOLD} SELECT doc_id, symbol, content, start_line, end_line FROM k")
def chunk_by_lines(spark, d):
    return chunking.chunk_by_lines(table(spark, d, "documents"), ["doc_id"], "text").drop("kind")


@query(f"WITH RECURSIVE {_FOLD} SELECT lang, count(*) AS n, CAST(sum(length(content) // 4) AS BIGINT) AS tokens, CAST(max(length(content)) AS INTEGER) AS longest FROM k GROUP BY lang")
def chunk_stats_by_language(spark, d):
    c = chunking.chunk_by_lines(table(spark, d, "documents"), ["doc_id", "lang"], "text")
    return c.groupBy("lang").agg(F.count("*").alias("n"), F.sum(X.approx_tokens(F.col("content"))).alias("tokens"), F.max(F.length("content")).alias("longest"))


_DEFINITIONS = ", ".join(f"('{lang}', '{name}', CAST({first} AS INTEGER), CAST({last} AS INTEGER))" for lang, rows in samples.EXPECTED.items() for name, first, last in rows)


@query(f"SELECT * FROM (VALUES {_DEFINITIONS}) t(language, symbol, start_line, end_line)")
def definition_chunks(spark, d):
    """Definitions of one fixed source file per language with definition types, against the expected ones."""
    files = spark.createDataFrame([(f"sample.{lang}", lang, text) for lang, text in samples.SOURCES.items()], "path string, language string, content string")
    return chunking.chunk_files(files, 1).where("kind = 'definition'").select("language", "symbol", "start_line", "end_line")


@query()
def definition_chunks_table(spark, d):
    """Definitions of all chunks, each taken as a file; those without one by lines."""
    c = chunks(spark, d)
    return chunking.chunk_files(c.select(F.concat("file_path", F.lit("#"), "id").alias("path"), X.language_of(F.col("file_path")).alias("language"), "content"))


# ---------------------------------------------------------------- quality

_QW = "qw AS (SELECT DISTINCT query_id, unnest(string_split_regex(lower(trim(query_text)), '\\s+')) AS word FROM bench_queries), qv AS (SELECT * FROM qw WHERE word <> ''), sz AS (SELECT file_path, CAST(sum(length(content)) // 4 AS BIGINT) AS tokens FROM code_chunks GROUP BY file_path)"


@query(f"WITH {_QW}, hit AS (SELECT DISTINCT query_id, file_path FROM qv JOIN code_chunks ON contains(content, word)), n AS (SELECT query_id, count(*) AS n_files, CAST(sum(tokens) AS BIGINT) AS n_tokens FROM hit JOIN sz USING (file_path) GROUP BY query_id) SELECT b.query_id, coalesce(n_files, 0) AS n_files, coalesce(n_tokens, 0) AS n_tokens FROM bench_queries b LEFT JOIN n USING (query_id)")
def grep_naive_tokens(spark, d):
    return quality.grep_naive(chunks(spark, d), table(spark, d, "bench_queries"))


@query(f"WITH {_QW}, w AS (SELECT DISTINCT word FROM qv), o AS (SELECT file_path, word, CAST(sum((length(lower(content)) - length(replace(lower(content), word, ''))) // length(word)) AS BIGINT) AS c FROM code_chunks JOIN w ON contains(lower(content), word) GROUP BY file_path, word), h AS (SELECT query_id, file_path, CAST(sum(c) AS BIGINT) AS hits FROM qv JOIN o USING (word) GROUP BY query_id, file_path), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, file_path) AS rn FROM h) SELECT query_id, file_path, hits, tokens FROM r JOIN sz USING (file_path) WHERE rn <= 5")
def grep_smart_top5(spark, d):
    return quality.grep_smart(chunks(spark, d), table(spark, d, "bench_queries"))


@query("SELECT file_path, count(*) AS n_rows, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM code_chunks WHERE regexp_matches(content, 'retr(y|ies)|time[- ]?out|checksum') GROUP BY file_path")
def grep_regex_files(spark, d):
    return quality.grep_regex(chunks(spark, d), ["retr(y|ies)", "time[- ]?out", "checksum"])


_RES = "res AS (SELECT DISTINCT run_id, model, query_id, rank, chunk_id, score, tokens FROM query_results WHERE score IS NOT NULL AND NOT isnan(score))"


@query(
    f"WITH {_RES}, per AS (SELECT model, run_id, "
    + ", ".join(f"CASE WHEN count(*) FILTER (rank <= {n}) >= {n} THEN avg(round(score, 4)) FILTER (rank <= {n}) ELSE 0.0 END AS t{n}" for n in (1, 3, 5))
    + " FROM res GROUP BY model, run_id) SELECT model, count(*) AS n_runs, round(avg(t1), 6) AS top1, round(avg(t3), 6) AS top3, round(avg(t5), 6) AS top5 FROM per GROUP BY model"
)
def quality_top_means(spark, d):
    return quality.top_means(table(spark, d, "query_results"))


@query(f"WITH {_QW}, {_RES}, hit AS (SELECT DISTINCT query_id, file_path FROM qv JOIN code_chunks ON contains(content, word)), n AS (SELECT query_id, CAST(sum(tokens) AS BIGINT) AS t FROM hit JOIN sz USING (file_path) GROUP BY query_id), base AS (SELECT avg(coalesce(t, 0)) AS b FROM bench_queries LEFT JOIN n USING (query_id)), m AS (SELECT model, avg(t) AS a FROM (SELECT model, run_id, sum(tokens) AS t FROM res GROUP BY model, run_id) GROUP BY model) SELECT model, round(a, 4) AS avg_tokens, round(b, 4) AS baseline_tokens, round(CASE WHEN a = 0 OR a IS NULL THEN 0.0 ELSE b / a END, 4) AS reduction FROM m, base")
def context_reduction(spark, d):
    return quality.context_reduction(table(spark, d, "query_results"), grep_naive_tokens(spark, d))


@query(f"WITH {_RES} SELECT run_id, rank, chunk_id, file_path, symbol, round(score, 4) + 0.0 AS score FROM res JOIN code_chunks c ON c.id = res.chunk_id")
def result_chunks(spark, d):
    return quality.hits_with_chunks(table(spark, d, "query_results"), chunks(spark, d))


# ---------------------------------------------------------------- embedding and streams

# the provider's vectors: words by a hash, its lowest bit the sign, the others the place; stored as floats
_VEC = """(SELECT id, list(CAST(v / n AS FLOAT) ORDER BY b) AS e FROM (SELECT id, b, v, sqrt(sum(v * v) OVER (PARTITION BY id)) AS n FROM
  (SELECT x.id, x.b, CAST(coalesce(y.v, 0) AS DOUBLE) AS v FROM (SELECT id, b FROM {ids}, range({dim}) r(b)) x LEFT JOIN
    (SELECT id, ((h >> 1) % {dim}) AS b, sum(CASE WHEN h & 1 = 1 THEN 1 ELSE -1 END) AS v FROM
      (SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM (SELECT id, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS w FROM {texts})) GROUP BY ALL) y ON x.id = y.id AND x.b = y.b)) WHERE n > 0 GROUP BY id)"""


def _runs_sql(models: dict[str, int]) -> str:
    """Ranks of all chunks for all queries, with the hashing provider in several dimensions."""
    part = []
    for name, dim in models.items():
        c, q = (_VEC.format(dim=dim, ids=x, texts=x) for x in ("(SELECT id, content AS t FROM code_chunks)", "(SELECT query_id AS id, query_text AS t FROM bench_queries)"))
        score = "round(list_inner_product(c.e::DOUBLE[], q.e::DOUBLE[]) / (sqrt(list_inner_product(c.e::DOUBLE[], c.e::DOUBLE[])) * sqrt(list_inner_product(q.e::DOUBLE[], q.e::DOUBLE[]))), 9)"
        part.append(f"SELECT '{name}' AS model, CAST(q.id AS BIGINT) AS query_id, c.id AS chunk_id, {score} AS s FROM {c} c, {q} q")
    return f"SELECT model, query_id, chunk_id, s, CAST(row_number() OVER (PARTITION BY model, query_id ORDER BY s DESC, chunk_id) AS INTEGER) AS rank FROM ({' UNION ALL '.join(part)})"


@query(f"SELECT query_id, chunk_id, round(s, 4) + 0.0 AS score, rank FROM ({_runs_sql({'hashing': DIM})}) WHERE rank <= 10")
def hash_embed_topk(spark, d):
    """Texts of the bench queries against chunk contents, both embedded by the hashing provider."""
    c = embed(chunks(spark, d).select("id", "content"), HashingProvider).select("id", "embedding")
    q = embed(table(spark, d, "bench_queries").select(F.col("query_id").cast("bigint").alias("query_id"), F.col("query_text").alias("content")), HashingProvider).select("query_id", "embedding")
    return search.batch_search(c, q)


@query(f"SELECT model, query_id, rank, chunk_id, round(s, 4) + 0.0 AS score, CAST(length(content) // 4 AS BIGINT) AS tokens FROM ({_runs_sql({'narrow': 32, 'wide': 64})}) r JOIN code_chunks c ON c.id = r.chunk_id WHERE rank <= 10")
def quality_runs(spark, d):
    """Every bench query against every chunk, with two models."""
    return quality.run_models(chunks(spark, d), table(spark, d, "bench_queries"), {"narrow": partial(HashingProvider, 32), "wide": partial(HashingProvider, 64)})


@query("SELECT DISTINCT path, mtime FROM source_files")
def stream_incremental(spark, d):
    """Files of the listing with their modification, each once, from a stream that takes what is there.

    A file seen again with the same modification is dropped, whatever length is listed then.
    """
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = incremental.changed_stream(spark, f"{d}/source_files.parquet")
    incremental.run_available(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}"), f"{base}/state")
    out = spark.read.parquet(f"{base}/out").select("path", "mtime").distinct()
    # the result moves to a checkpoint, so that neither output nor state of the stream stays behind
    done = cut_lineage(out)
    Folder(spark, base).delete("")
    return done


@query("SELECT CAST(date_trunc('day', seen_at) AS TIMESTAMP) AS day, count(*) AS n FROM source_files GROUP BY 1")
def stream_counts_per_day(spark, d):
    """Sightings per day as a windowed aggregate of the stream, all days closed at its end."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    incremental.run_complete(incremental.counts_per_day(spark, f"{d}/source_files.parquet"), f"{base}/out", f"{base}/state")
    done = cut_lineage(spark.read.parquet(f"{base}/out").select(F.col("day").cast("timestamp_ntz").alias("day"), "n"))
    Folder(spark, base).delete("")
    return done
