"""Embedding providers as pandas UDFs: batches, retries and dimension checks inside the task."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F

from lodestone.errors import ConfigError

BATCH, ATTEMPTS, WAIT = 32, 3, (1.0, 10.0)
#: Dimensions of known models (fixed values).
DIMENSIONS = {
    "nomic-embed-text": 768,
    "bge-large-en-v1.5": 1024,
    "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072,
    "text-embedding-ada-002": 1536,
    "voyage-3": 1024,
    "voyage-3-lite": 512,
    "voyage-code-3": 1024,
    "embed-english-v3.0": 1024,
    "embed-english-light-v3.0": 384,
}

Embed = Callable[[list[str]], list[list[float]]]


def batched(items: list, n: int) -> Iterator[list]:
    """Consecutive sublists of at most ``n``."""
    for i in range(0, len(items), n):
        yield items[i : i + n]


def hash_embedder(dimension: int) -> Embed:
    """A deterministic stand-in: token hashes added up, no service needed."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dimension
            for token in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
                v[h % dimension] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out

    return embed


Post = Callable[[str, dict, dict[str, str]], dict]


def http_post(url: str, body: dict, headers: dict[str, str]) -> dict:
    import json
    import urllib.request

    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=30) as answer:
        return json.load(answer)


def service(path: str, ask: Callable[[str, list[str]], dict], read: Callable[[dict], list[list[float]]], *, url: str, needs_key: bool = True) -> Callable[..., Embed]:
    """A factory of providers that ask an HTTP service: ``ask`` makes the request's body, ``read`` takes the vectors out."""

    def make(model: str, *, base_url: str = url, api_key: str | None = None, post: Post = http_post, **_) -> Embed:
        if needs_key and not api_key:
            raise ConfigError("this embedding provider needs an api_key")
        headers = {"Authorization": f"Bearer {api_key}"} if api_key else {}

        def embed(texts: list[str]) -> list[list[float]]:
            found = read(post(base_url.rstrip("/") + path, ask(model, texts), headers))
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
            return found

        return embed

    return make


def _by_index(answer: dict) -> list[list[float]]:
    return [d["embedding"] for d in sorted(answer["data"], key=lambda d: d.get("index", 0))]


#: Provider name to a factory of (model, options). Addresses and paths are those of the services' public APIs.
PROVIDERS: dict[str, Callable[..., Embed]] = {
    "hash": lambda model, dimension=256, **_: hash_embedder(dimension),
    "ollama": service("/api/embed", lambda m, t: {"model": m, "input": t}, lambda a: a["embeddings"], url="http://localhost:11434", needs_key=False),
    "openai": service("/embeddings", lambda m, t: {"model": m, "input": t}, _by_index, url="https://api.openai.com/v1"),
    "voyage": service("/embeddings", lambda m, t: {"model": m, "input": t}, _by_index, url="https://api.voyageai.com/v1"),
    "cohere": service("/embed", lambda m, t: {"model": m, "texts": t, "input_type": "search_document", "embedding_types": ["float"]}, lambda a: a["embeddings"]["float"], url="https://api.cohere.com/v2"),
}


def provider(name: str, model: str = "", **options) -> Embed:
    if name not in PROVIDERS:
        raise ConfigError(f"unknown embedding provider {name!r}", known=sorted(PROVIDERS))
    return PROVIDERS[name](model, **options)


def embedder(embed: Embed, dimension: int, *, batch: int = BATCH, attempts: int = ATTEMPTS):
    """A column function from text to array<float>; failures are retried with exponential waits, then raised."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            vectors: list[list[float]] = []
            for some in batched(texts.fillna("").tolist(), batch):
                for attempt in range(attempts):
                    try:
                        found = embed(some)
                        break
                    except Exception:
                        if attempt == attempts - 1:
                            raise
                        time.sleep(min(WAIT[1], WAIT[0] * 2**attempt))
                if any(len(v) != dimension for v in found):
                    raise ValueError(f"expected vectors of {dimension} dimensions")
                vectors += found
            yield pd.Series(vectors)

    return run
