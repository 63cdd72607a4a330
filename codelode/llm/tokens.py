"""Encoding text columns with a public byte-level BPE tokenizer, and decoding ids again.

Both run over Arrow batches. The vocabulary file is a parameter; every Python worker loads it
once. Ids of a null, empty or untokenisable text are an empty list.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Texts are handed to the library in groups of about so many characters, which bounds its memory.
GROUP_CHARS = 2_000_000


@lru_cache(maxsize=4)
def load(path: str = VOCABULARY):
    """The tokenizer of ``path``; strings of special tokens are ordinary text to it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = True
    return tok


def printable_bytes() -> list[int]:
    """Bytes that stand for themselves in a byte-level vocabulary (fixed values)."""
    return [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_to_char() -> dict[int, str]:
    """The reversible byte table: printable bytes keep their code, the rest follow from U+0100 on."""
    keep = set(printable_bytes())
    others = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(others)}


@lru_cache(maxsize=4)
def id_bytes(path: str = VOCABULARY) -> list[bytes]:
    """The bytes of every id, by reversing the byte table over the vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {c: b for b, c in byte_to_char().items()}
    vocab = spec["model"]["vocab"]
    special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    out = [b""] * (max([*vocab.values(), *special]) + 1)
    for piece, k in vocab.items():
        out[k] = special[k] if k in special else bytes(back[c] for c in piece)
    for k, raw in special.items():
        out[k] = raw
    return out


def decode_ids(ids, path: str = VOCABULARY) -> str | None:
    """Text of a list of ids; characters split over ids come together, cut ones become U+FFFD."""
    if ids is None:
        return None
    table = id_bytes(path)
    return b"".join([table[i] for i in ids]).decode("utf-8", errors="replace")


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group: list[str] = []
    held = 0
    for text in texts:
        if group and held + len(text) > GROUP_CHARS:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def _ids_array(encodings) -> tuple[pa.Array, list]:
    import numpy as np

    lists = [e.ids for e in encodings]
    sizes = np.fromiter((len(x) for x in lists), dtype=np.int64, count=len(lists))
    ends = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum(sizes, out=ends[1:])
    flat = np.fromiter((v for x in lists for v in x), dtype=np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), lists


def encode(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str = VOCABULARY,
    offsets: bool = False,
) -> DataFrame:
    """One row per row of ``df``: id, ``ids array<int>`` and on request the character spans.

    ``starts`` and ``ends`` give for each id the span of characters it came from (the library's
    byte offsets mapped to characters); ids that hold parts of one character share its span.
    A null and an empty text give empty lists. Other columns are dropped before the Python step,
    so columns with clashing names cannot disturb it. Repeated rows stay repeated.
    """
    src = spread(df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")))
    fields = [T.StructField(id_col, src.schema["__id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if offsets:
        fields += [T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        for batch in batches:
            at = 0
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for group in _groups(texts):
                enc = tok.encode_batch(group, add_special_tokens=False)
                ids, _ = _ids_array(enc)
                cols = [batch.column(0).slice(at, len(group)), ids]
                if offsets:
                    cols.append(pa.array([[a for a, _ in e.offsets] for e in enc], pa.list_(pa.int32())))
                    cols.append(pa.array([[b for _, b in e.offsets] for e in enc], pa.list_(pa.int32())))
                at += len(group)
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return src.mapInArrow(run, T.StructType(fields))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``(id, n_tokens)`` per row; only the number leaves the Python worker."""
    src = spread(df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")))
    schema = T.StructType([T.StructField(id_col, src.schema["__id"].dataType), T.StructField("n_tokens", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [len(e.ids) for group in _groups(texts) for e in tok.encode_batch(group, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], names=schema.names)

    return src.mapInArrow(run, schema)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``(id, text)`` from lists of ids; a null list gives a null text, an empty one an empty text."""
    src = df.select(F.col(id_col).alias("__id"), F.col(ids_col).alias("__ids"))
    schema = T.StructType([T.StructField(id_col, src.schema["__id"].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(ids, path) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)
