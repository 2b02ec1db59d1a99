"""Models behind interfaces: completion and embedding in batches, with retries.

A completer or embedder is made once in each Python worker by a factory that is shipped
to it; credentials come from the environment there. The stubs are deterministic and need
no network.
"""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = dict[str, str]


class Completer(Protocol):
    def complete(self, messages: list[Message], **options) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


_instances: dict[str, object] = {}


def instance(name: str, factory: Callable[[], object]):
    """One object for each model name in this process."""
    if name not in _instances:
        _instances[name] = factory()
    return _instances[name]


def with_retry(call: Callable, attempts: int = 5, least: float = 1.0, most: float = 60.0, sleep=time.sleep):
    """call, tried again after exponential waits; the last error is raised."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k + 1 == attempts:
                raise
            sleep(min(most, least * 2**k) * (0.5 + random.random() / 2))


class EchoCompleter:
    """Answers with the JSON of the last user message's hash: a stand-in for tests."""

    def complete(self, messages: list[Message], **options) -> str:
        last = next((m["content"] for m in reversed(messages) if m["role"] == "user"), "")
        digest = hashlib.md5(last.encode()).hexdigest()
        return json.dumps({"input": f"question {digest[:8]}", "output": f"answer {digest} " * 5})


class HashEmbedder:
    """Unit vectors from character trigram hashes: a stand-in for tests."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for k in range(max(1, len(t) - 2)):
                h = int.from_bytes(hashlib.blake2b(t[k : k + 3].encode(), digest_size=8).digest(), "little")
                out[i, h % self.size] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def completed(
    requests: DataFrame, factory: Callable[[], Completer], model: str = "stub", concurrency: int = 10,
    attempts: int = 5, key: str = "idx", messages: str = "messages",
) -> DataFrame:
    """(key, response, error): every request is answered, one failure does not fail the rest."""
    kind = requests.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = instance(model, factory)

        def one(cell):
            try:
                got = with_retry(lambda: client.complete([dict(m) if isinstance(m, dict) else m.asDict() for m in cell]), attempts)
                return got, None
            except Exception as e:  # noqa: BLE001  the error is the result
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                rows = list(pool.map(one, batch[messages]))
                yield pd.DataFrame({key: batch[key], "response": [r for r, _ in rows], "error": [e for _, e in rows]})

    return requests.select(key, messages).mapInPandas(run, f"`{key}` {kind}, response string, error string")


def completed_chunks(chunks: DataFrame, factory, keep: Callable[[DataFrame, int], DataFrame], attempts: int = 3, **options) -> DataFrame:
    """Chunks (chunk, messages) with responses; only failed ones are tried again, and what still fails is left out.

    keep(frame, attempt) writes the successes of an attempt and reads them again.
    """
    left, done = chunks, None
    for k in range(attempts):
        got = keep(completed(left, factory, key="chunk", **options).where("error is null").select("chunk", "response"), k)
        done = got if done is None else done.unionByName(got)
        left = chunks.join(done, "chunk", "left_anti")
        if left.isEmpty():
            break
    return done


def embedded(rows: DataFrame, factory: Callable[[], Embedder], text: str, model: str = "stub", batch: int = 64) -> DataFrame:
    """rows with a normalised embedding of a text column."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = instance(f"embed-{model}", factory)
        for part in parts:
            texts = [t or "" for t in part]
            out = [client.embed(texts[a : a + batch]) for a in range(0, len(texts), batch)]
            yield pd.Series(list(np.concatenate(out).astype(np.float32)) if out else [])

    return rows.withColumn("embedding", embed(F.col(text)))
