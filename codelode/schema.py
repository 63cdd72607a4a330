"""Schemas of the tables and the constant tables of the engine (fixed values)."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNKS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("language", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("content", T.StringType(), False),
        T.StructField("summary", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
PROJECTS = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("last_indexed", T.TimestampType()),
        T.StructField("total_chunks", T.IntegerType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
FILES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("language", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

#: Extension to language.
EXTENSIONS = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "tsx", ".jsx": "jsx", ".go": "go", ".rs": "rust", ".java": "java",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cs": "c_sharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin",
    ".scala": "scala", ".lua": "lua", ".r": "r", ".sh": "bash", ".sql": "sql", ".html": "html", ".css": "css", ".json": "json",
    ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".md": "markdown",
}

#: Directories that are not walked, besides those whose names start with a dot.
SKIP_DIRS = ("node_modules", ".git", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", ".nuxt", "target", "vendor", ".tox", ".mypy_cache", ".pytest_cache", ".idea", ".vscode")

MIN_CHUNK, MAX_CHUNK = 100, 2000

#: Model to (dimension, longest text, backend), and the public ids of those loaded in process.
MODELS = {"modernbert-embed-base": (768, 32_768, "local"), "modernbert-embed-large": (1024, 32_768, "local"), "nomic-embed-text": (768, 32_000, "http"), "hashing": (64, None, "hashing")}
MODEL_IDS = {"modernbert-embed-base": "nomic-ai/modernbert-embed-base", "modernbert-embed-large": "lightonai/modernbert-embed-large"}
DEFAULT_MODEL = "modernbert-embed-base"
DEFAULT_DIM, DEFAULT_CHARS, EMBED_BATCH = 768, 32_000, 16
