"""Embedding providers and the operator that fills the embedding column with one of them."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode import schema


class Provider(Protocol):
    """Turns texts into vectors; None where a text could not be embedded."""

    dim: int

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...

    def close(self) -> None: ...


class HashingProvider:
    """Deterministic bag of hashed words, of length 1; needs no model. Texts without words give None."""

    def __init__(self, dim: int = 64, max_chars: int | None = None):
        self.dim, self.max_chars = dim, max_chars  # a bag of words has no longest text of its own

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in re.findall(r"[a-z0-9]+", t[: self.max_chars].lower()):
                h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                v[(h >> 1) % self.dim] += 1.0 if h & 1 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return out

    def close(self) -> None:
        pass


class HttpProvider:
    """One request per text to ``url`` with ``{model, prompt}``; retried with growing waits.

    ``send`` can replace the transport. After the last attempt the text counts as failed (None)
    instead of a vector that looks valid.
    """

    def __init__(self, model: str, url: str, dim: int, max_chars: int = schema.DEFAULT_CHARS, attempts: int = 3, timeout: float = 30.0, pause: float = 0.5, send: Callable[[dict], dict] | None = None):
        self.model, self.url, self.dim, self.max_chars = model, url, dim, max_chars
        self.attempts, self.timeout, self.pause = attempts, timeout, pause
        self.send = send or self._post

    def _post(self, body: dict) -> dict:
        from urllib.request import Request, urlopen

        req = Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urlopen(req, timeout=self.timeout) as r:  # noqa: S310
            return json.load(r)

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for t in texts:
            got = None
            for attempt in range(self.attempts):
                try:
                    v = self.send({"model": self.model, "prompt": t[: self.max_chars]}).get("embedding")
                    if v is not None and len(v) == self.dim:
                        got = [float(x) for x in v]
                        break
                except Exception:  # noqa: BLE001 - any failure of the service is retried
                    pass
                if attempt + 1 < self.attempts:
                    time.sleep(self.pause * 2 ** (attempt + 1))
            out.append(got)
        return out

    def close(self) -> None:
        pass


class LocalProvider:
    """A sentence-embedding model in this process; texts are cut to ``max_chars`` and vectors have length 1.

    Known names stand for public model ids, names with a ``/`` are ids themselves. The model is
    loaded with the first texts, so once per Python worker; a missing library is a RuntimeError
    that names it. ``load`` can replace the loader: a function of the id that gives an object with
    ``encode(texts, batch_size=..., show_progress_bar=..., normalize_embeddings=...)``.
    """

    def __init__(self, model: str = schema.DEFAULT_MODEL, dim: int | None = None, max_chars: int | None = None, batch: int = schema.EMBED_BATCH, load: Callable[[str], object] | None = None):
        known = schema.MODELS.get(model)
        if known is None and "/" not in model:
            raise ValueError(f"unknown model: {model}; known are {', '.join(schema.MODEL_IDS)}, or a full id such as org/name")
        self.model_id = schema.MODEL_IDS.get(model, model)
        self.dim = dim or (known[0] if known else schema.DEFAULT_DIM)
        self.max_chars = max_chars or (known[1] if known else schema.DEFAULT_CHARS)
        self.batch, self._load, self._model = batch, load or self._library, None

    @staticmethod
    def _library(model_id: str):
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise RuntimeError("models in process need the library sentence-transformers on every worker") from e
        return SentenceTransformer(model_id)

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        if not texts:
            return []
        if self._model is None:
            self._model = self._load(self.model_id)
        out: list[list[float] | None] = []
        for lo in range(0, len(texts), self.batch):
            part = [t[: self.max_chars] for t in texts[lo : lo + self.batch]]
            got = np.asarray(self._model.encode(part, batch_size=len(part), show_progress_bar=False, normalize_embeddings=True), dtype=np.float64)
            for v in got:
                n = np.linalg.norm(v)
                out.append((v / n).tolist() if len(v) == self.dim and n and np.isfinite(n) else None)
        return out

    def close(self) -> None:
        self._model = None


_REGISTRY: dict[str, Callable[..., Provider]] = {
    "hashing": lambda model, **kw: HashingProvider(**kw),
    "http": lambda model, **kw: HttpProvider(model, **kw),
    "local": lambda model, **kw: LocalProvider(model, **kw),
}


def register(backend: str, make: Callable[..., Provider]) -> None:
    """Adds a backend, or replaces one."""
    _REGISTRY[backend] = make


def create_provider(model: str = "hashing", backend: str | None = None, **options) -> Provider:
    """The provider of a model; unknown backends are a ValueError, names with ``/`` pass through."""
    known = schema.MODELS.get(model)
    backend = backend or (known[2] if known else "local")
    if backend not in _REGISTRY:
        raise ValueError(f"unknown embedding backend: {backend}")
    if known is None and "/" not in model:
        raise ValueError(f"unknown model: {model}")
    return _REGISTRY[backend](model, **options)


def embed(df: DataFrame, make: Callable[[], Provider], text_col: str = "content", out_col: str = "embedding", batch: int = schema.EMBED_BATCH) -> DataFrame:
    """``df`` with a vector column; the provider is made once per Python worker and fed in batches.

    Null and blank texts, failures and vectors of a wrong dimension give null, so that a failed
    embedding can never be found by a search.
    """

    @F.pandas_udf("array<float>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make()
        try:
            for texts in it:
                out: list = [None] * len(texts)
                todo = [k for k, t in enumerate(texts) if isinstance(t, str) and t.strip()]
                for lo in range(0, len(todo), batch):
                    part = todo[lo : lo + batch]
                    for k, v in zip(part, provider.embed([texts.iloc[j] for j in part]), strict=True):
                        out[k] = v if v is not None and len(v) == provider.dim else None
                yield pd.Series(out, dtype=object)
        finally:
            provider.close()

    return df.withColumn(out_col, run(F.col(text_col)))
