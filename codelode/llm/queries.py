"""Queries of the training-data problems, by number, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import credentials, encodings, generated, neardup, neighbours, packing, parsing, pieces, tokens
from codelode.session import table

#: Words per shingle and similarity that TESTDATA.md states for problem 5.
P5 = {"words": 3, "similarity": 0.6}


# 1: files that were not written by hand


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Generated, minified and copied files, and data kept as code."""
    return p1_reasons(spark, d).select("file_path")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The same files with the reason."""
    return generated.not_hand_written(table(spark, d, "code_chunks"), table(spark, d, "ext_languages"))


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the chunks of all other files."""
    return table(spark, d, "code_chunks").select("id", "file_path").join(p1_found(spark, d), "file_path", "left_anti").select("id")


# 2: splitting oversized items


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose content has to be cut."""
    cut = pieces.split_pieces(table(spark, d, "code_chunks"), keep_small=False)
    return cut.where("piece_no = 0 and n_pieces > 1").select("id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all chunks, with their overlap and lines."""
    return pieces.split_pieces(table(spark, d, "code_chunks"))


# 3: credentials in source code


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines on which a credential begins."""
    return credentials.find_credentials(table(spark, d, "code_chunks")).select("id", "line_no").distinct()


def p3_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every credential with its place in the content."""
    return credentials.find_credentials(table(spark, d, "code_chunks"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Content of every chunk, with credentials blanked."""
    return credentials.find_credentials(table(spark, d, "code_chunks"), redact=True, only_found=False)


def p3_redaction(spark: SparkSession, d: str) -> DataFrame:
    """Per chunk: characters and line ends after blanking, and characters changed to anything but the blank."""
    before = table(spark, d, "code_chunks").select("id", F.col("content").alias("old"))
    both = p3_redacted(spark, d).join(before, "id")
    other = F.size(F.filter(F.zip_with(F.split("old", ""), F.split("content", ""), lambda x, y: (x != y) & (y != credentials.BLANK)), lambda z: z))
    breaks = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return both.select("id", F.length("content").alias("n_chars"), breaks.alias("n_breaks"), other.alias("n_other"))


# 4: functions with their documentation


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions with a description of at least five words, of files that parse."""
    return parsing.documented_functions(table(spark, d, "code_chunks"), table(spark, d, "ext_languages"), with_code=False).select("id", "function_name")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code and description pairs, broken files' whole functions included, templates left out."""
    found = parsing.documented_functions(table(spark, d, "code_chunks"), table(spark, d, "ext_languages"), keep_invalid=True)
    return parsing.without_templates(found)


# 5: near-duplicate records


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of similar chunks."""
    members, links = neardup.near_duplicate_classes(table(spark, d, "code_chunks"), **P5)
    return neardup.near_duplicate_pairs(members, links, expand=None).select("id_a", "id_b")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with its group of similar chunks and its number of links."""
    members, links = neardup.near_duplicate_classes(table(spark, d, "code_chunks"), **P5)
    return neardup.near_duplicate_groups(members, links)


# 6: files that do not parse


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Files with a chunk that every dialect of their language rejects."""
    return parsing.invalid_files(table(spark, d, "code_chunks"), table(spark, d, "ext_languages"))


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """Their share per project and language."""
    return parsing.invalid_rates(table(spark, d, "code_chunks"), table(spark, d, "ext_languages"), table(spark, d, "projects"))


# 7: most similar vectors


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Up to five neighbours per chunk, of similarity 0.9 or more."""
    return neighbours.nearest_neighbours(table(spark, d, "code_chunks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Unordered pairs of which one is among the other's neighbours."""
    n = p7_neighbours(spark, d)
    return n.select(F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b")).distinct()


# 8: encoding with a public tokenizer


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, d, "documents"))


def p8_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Token ids with the characters they came from."""
    return tokens.encode(table(spark, d, "documents"), offsets=True)


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts put together again from their ids; null texts come back empty."""
    return tokens.decode(tokens.encode(table(spark, d, "documents")))


# 9: filling containers


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document or piece of one."""
    return packing.pack_documents(table(spark, d, "documents"))[0]


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Use of every container."""
    packed, _ = packing.pack_documents(table(spark, d, "documents"))
    return packed.groupBy("container").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"), (F.lit(packing.CAPACITY) - F.sum("n_tokens")).alias("n_free"))


def p9_certificate(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the bound below which no packing gets, and the partitions that met theirs."""
    _, info = packing.pack_documents(table(spark, d, "documents"))
    return spark.createDataFrame([tuple(info[k] for k in ("containers", "lower_bound", "certified", "partitions", "certified_partitions", "rounds"))], "containers bigint, lower_bound bigint, certified boolean, partitions bigint, certified_partitions bigint, rounds int")


# 10: wrong character encodings


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that show characters of a wrong decoding."""
    return encodings.restore_encoding(table(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """Their texts, restored where nothing was lost, with the number of places and of losses."""
    return encodings.restore_encoding(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_reasons, p1_kept, p2_found, p2_pieces, p3_found, p3_spans, p3_redacted, p3_redaction, p4_found, p4_pairs, p5_found, p5_groups, p6_found, p6_rates, p7_found, p7_neighbours, p8_ids, p8_offsets, p8_decoded, p9_packed, p9_containers, p9_certificate, p10_found, p10_restored)}

ORACLE_SQL: dict[str, str] = {
    "p2_found": "SELECT id FROM code_chunks WHERE length(content) > 2000",
    "p3_redaction": "SELECT id, CAST(length(content) AS INTEGER) AS n_chars, CAST(length(content) - length(replace(content, chr(10), '')) AS INTEGER) AS n_breaks, 0 AS n_other FROM code_chunks",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
