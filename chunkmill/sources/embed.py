"""Embedders: an HTTP client for an OpenAI-style endpoint, and a deterministic offline one. Vectors of a wrong length are fatal."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from chunkmill.plans.schema import CODE_PREFIX, EMBED_BATCH, EMBED_DIM, EMBED_MODEL, QUERY_PREFIX


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class BadVectors(ValueError):
    """The embedder's answer doesn't fit what was asked: wrong number or length of vectors."""


def fitting(vectors: list[list[float]], count: int, dim: int) -> list[list[float]]:
    """The vectors, if there are count of them and all have dim numbers."""
    sizes = {len(v) for v in vectors}
    if len(vectors) != count or sizes - {dim}:
        raise BadVectors(f"asked for {count} vectors of {dim} dimensions, got {len(vectors)} of {sorted(sizes)}")
    return vectors


# The route of the embedding service.
ROUTE = "/v1/embeddings"


@dataclass
class HttpEmbedder:
    """An embedding service over HTTP that takes and gives JSON; requests hold at most batch texts."""

    url: str
    model: str = EMBED_MODEL
    dim: int = EMBED_DIM
    batch: int = EMBED_BATCH
    timeout: float = 120.0
    query_timeout: float = 30.0
    post: Callable[[str, dict, float], dict] | None = None

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [v for some in itertools.batched(texts, self.batch) for v in self._ask(list(some), self.timeout)]

    def embed_one(self, text: str) -> list[float]:
        """A query's vector, for which somebody waits."""
        return self._ask([text], self.query_timeout)[0]

    def _ask(self, texts: list[str], timeout: float) -> list[list[float]]:
        answer = (self.post or post_json)(self.url.rstrip("/") + ROUTE, {"model": self.model, "input": texts}, timeout)
        placed = {row.get("index", k): row["embedding"] for k, row in enumerate(answer["data"])}
        return fitting([placed[k] for k in sorted(placed)], len(texts), self.dim)


def post_json(url: str, body: dict, timeout: float) -> dict:
    head = {"Content-Type": "application/json"}
    with urllib.request.urlopen(urllib.request.Request(url, data=json.dumps(body).encode(), headers=head, method="POST"), timeout=timeout) as answer:
        return json.loads(answer.read())


class HashEmbedder:
    """Signed hashes of words, normalised: for tests and offline use."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for word in re.findall(r"\w+", text.lower()) or [""]:
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out


def embed_query(embedder: Embedder, text: str) -> list[float]:
    """Queries carry the prefix, code doesn't; an embedder may have a way of its own for a single text."""
    one = getattr(embedder, "embed_one", None)
    vectors = [one(QUERY_PREFIX + text)] if one else embedder.embed([QUERY_PREFIX + text])
    return fitting(vectors, 1, embedder.dim)[0]


def embed_chunks(chunks: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """chunks with vector, in the same row: batches of EMBED_BATCH within a partition, one client for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = [CODE_PREFIX + (t or "") for t in batch.column(text).to_pylist()]
            vectors = [v for some in itertools.batched(strings, EMBED_BATCH) for v in fitting(embedder.embed(list(some)), len(some), embedder.dim)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*batch.schema.names, "vector"])

    fields = ", ".join(f"`{n}` {t}" for n, t in chunks.dtypes)
    return chunks.mapInArrow(run, f"{fields}, vector array<float>")
