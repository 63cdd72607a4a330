"""Cutting files into chunks: definitions where a parser knows them, else a fold over lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode import schema
from codelode.functions import text as X
from codelode.operators.definitions import SYNTAX, definitions


def line_fold(text: Column, min_chars: int = schema.MIN_CHUNK, max_chars: int = schema.MAX_CHUNK) -> Column:
    """``array<struct<start_line, end_line>>``: lines are added up until they reach ``max_chars``.

    The line that reaches it still belongs to the chunk. The rest at the end counts only from
    ``min_chars`` on. Its state is a running length, so the fold is linear in the text.
    """
    piece = "struct<start_line:int,end_line:int>"
    zero = F.struct(F.lit(0).alias("i"), F.lit(1).alias("st"), F.lit(-1).alias("len"), F.array().cast(f"array<{piece}>").alias("out"))

    def step(a: Column, line: Column) -> Column:
        i = a["i"] + 1
        size = a["len"] + 1 + F.length(line)
        full = size >= max_chars
        cut = F.struct(a["st"].alias("start_line"), i.alias("end_line"))
        return F.struct(
            i.alias("i"),
            F.when(full, i + 1).otherwise(a["st"]).alias("st"),
            F.when(full, F.lit(-1)).otherwise(size).alias("len"),
            F.when(full, F.concat(a["out"], F.array(cut))).otherwise(a["out"]).alias("out"),
        )

    def last(a: Column) -> Column:
        return F.when(a["len"] >= min_chars, F.concat(a["out"], F.array(F.struct(a["st"].alias("start_line"), a["i"].alias("end_line"))))).otherwise(a["out"])

    return F.aggregate(X.lines(text), zero, step, last)


def chunk_by_lines(df: DataFrame, key_cols: list[str], text_col: str, min_chars: int = schema.MIN_CHUNK, max_chars: int = schema.MAX_CHUNK) -> DataFrame:
    """One row per line block: key columns, ``symbol``, ``content``, ``start_line``, ``end_line``, ``kind``.

    Null and blank texts give no chunk. Line ends are read as in text mode.
    """
    src = df.select(*key_cols, X.unix_lines(F.col(text_col)).alias("__t")).where(F.col("__t").isNotNull() & ~X.is_blank(F.col("__t")))
    cut = src.select(*key_cols, "__t", F.explode(line_fold(F.col("__t"), min_chars, max_chars)).alias("__c"))
    s, e = F.col("__c.start_line"), F.col("__c.end_line")
    return cut.select(
        *key_cols,
        F.concat(F.lit("<block_"), s, F.lit(">")).alias("symbol"),
        F.array_join(F.slice(X.lines(F.col("__t")), s, e - s + 1), "\n").alias("content"),
        s.alias("start_line"),
        e.alias("end_line"),
        F.lit("line_based").alias("kind"),
    )


def chunk_files(files: DataFrame, min_chars: int = schema.MIN_CHUNK) -> DataFrame:
    """``(file_path, language, symbol, content, start_line, end_line, kind)`` of files ``(path, language, content)``.

    Files of a language with definition types are cut at their top-level definitions, in Arrow
    batches; the others, and those without a definition, are folded by lines inside the JVM.
    Unknown languages and blank files give nothing.
    """
    src = files.where(F.col("language").isNotNull() & F.col("content").isNotNull()).select(F.col("path").alias("file_path"), "language", X.unix_lines(F.col("content")).alias("content"))
    src = src.where(~X.is_blank(F.col("content")))
    schema_ddl = "file_path string, language string, symbol string, content string, start_line int, end_line int, kind string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, lang, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = definitions(t, lang, min_chars)
                if found is None:
                    rows.append((p, lang, None, t, None, None, "fold"))
                else:
                    rows += [(p, lang, s, c, a, b, k) for s, c, a, b, k in found]
            if rows:
                kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file_path", "language", "symbol", "content", "start_line", "end_line", "kind"])

    known = F.col("language").isin(*SYNTAX)
    parsed = src.where(known).mapInArrow(run, schema_ddl)
    keys = ["file_path", "language"]
    folded = chunk_by_lines(src.where(~known).unionByName(parsed.where("kind = 'fold'").select(*keys, "content")), keys, "content", min_chars)
    return parsed.where("kind <> 'fold'").unionByName(folded)
