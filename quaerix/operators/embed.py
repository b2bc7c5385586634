"""Embedding texts. The default hashes tokens; any model with the same two methods can take its place."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaerix.functions.text import TOKEN


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str], query: bool = False) -> np.ndarray:
        """float32 rows; *query* marks questions, which some models prefix."""


class HashingEmbedder:
    """Signed feature hashing of tokens with log counts, as unit vectors. Deterministic and offline."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def embed(self, texts: list[str], query: bool = False) -> np.ndarray:
        import re

        out = np.zeros((len(texts), self.dimension), dtype=np.float32)
        for i, text in enumerate(texts):
            for token in re.findall(TOKEN, text or ""):
                h = zlib.crc32(token.lower().encode())
                out[i, h % self.dimension] += 1.0 if h >> 31 else -1.0
            out[i] = np.sign(out[i]) * np.log1p(np.abs(out[i]))
            n = np.linalg.norm(out[i])
            out[i] /= n or 1.0
        return out


class RemoteEmbedder:
    """A model behind an HTTP endpoint for embeddings (JSON input in, vectors out), asked again when it is busy.

    Questions and documents may have a prefix each, which some models need.
    """

    def __init__(self, url: str, model: str, dimension: int, key: str = "", query_prefix: str = "", document_prefix: str = "", timeout: float = 60.0, post=None) -> None:
        self.url, self.model, self.dimension, self.key = url, model, dimension, key
        self.query_prefix, self.document_prefix, self.timeout, self.post = query_prefix, document_prefix, timeout, post

    def embed(self, texts: list[str], query: bool = False) -> np.ndarray:
        from quaerix.operators.answer import post_json, retrying

        if not texts:
            return np.zeros((0, self.dimension), np.float32)
        prefix = self.query_prefix if query else self.document_prefix
        body = {"model": self.model, "input": [prefix + (t or "") for t in texts]}
        head = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        said = retrying(lambda: (self.post or post_json)(self.url, body, head, self.timeout))
        out = np.array([d["embedding"] for d in sorted(said["data"], key=lambda d: d.get("index", 0))], dtype=np.float32)
        if out.shape != (len(texts), self.dimension):
            raise ValueError(f"{out.shape} vectors came back for {len(texts)} texts of dimension {self.dimension}")
        return out


def embedder_from(settings: dict) -> Embedder:
    """The embedder that settings name: ``provider`` is local (the default), remote, or auto: remote if there is a ``url``."""
    provider = settings.get("provider", "auto")
    if provider == "auto":
        provider = "remote" if settings.get("url") else "local"
    if provider == "local":
        return HashingEmbedder(int(settings.get("dimension", 64)))
    if provider == "remote":
        names = ("url", "model", "dimension", "key", "query_prefix", "document_prefix", "timeout")
        return RemoteEmbedder(**{k: settings[k] for k in names if k in settings})
    raise ValueError(f"no such embedding provider: {provider}")


def in_batches(embedder: Embedder, texts: list[str], batch: int, query: bool = False) -> np.ndarray:
    """Embed by batches; a batch that does not fit into memory is halved until it does."""
    rows, at = [], 0
    while at < len(texts):
        try:
            rows.append(embedder.embed(texts[at : at + batch], query))
        except MemoryError:
            if batch == 1:
                raise
            batch = max(1, batch // 2)
            continue
        at += batch
    return np.concatenate(rows) if rows else np.zeros((0, embedder.dimension), np.float32)


def embed(rows: DataFrame, embedder: Embedder, text: str, out: str = "embedding", batch: int = 256, query: bool = False) -> DataFrame:
    """Adds an array<float>; the model travels once to each task, texts as Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(in_batches(embedder, part.fillna("").tolist(), batch, query)), index=part.index)

    return rows.withColumn(out, run(F.col(text)))
