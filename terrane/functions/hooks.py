"""Model hooks: batch functions for embedding, scoring, extraction and generation, with deterministic doubles.

A hook is a function of lists, called once an Arrow batch, so a client may send one request for many rows. The doubles
depend on the text alone, so results do not change with the partitioning.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

RETRIES = 3


def embed_double(texts: list[str], dims: int = 64) -> list[list[float]]:
    """Hashed words, unit length."""
    out = []
    for t in texts:
        v = np.zeros(dims)
        for w in re.findall(r"\w+", (t or "").lower()):
            h = xxhash.xxh64_intdigest(w)
            v[h % dims] += 1 if h & (1 << 40) else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def score_double(queries: list[str], texts: list[str]) -> list[float]:
    """Cosine of the doubles' embeddings."""
    a, b = np.array(embed_double(queries)), np.array(embed_double(texts))
    return [round(float(x), 6) for x in (a * b).sum(1)] if len(queries) else []


def generate_double(prompts: list[str]) -> list[str]:
    """The last non-empty line of the prompt, without its label."""
    return [re.sub(r"^\w+:\s*", "", ([x for x in (p or "").split("\n") if x.strip()] or [""])[-1]) for p in prompts]


def retrying(generate: Callable[[list[str]], list[str]], times: int = RETRIES) -> Callable[[list[str]], list[str]]:
    """Asks again for the prompts that came back blank; failures give ''."""

    def run(prompts: list[str]) -> list[str]:
        out = [""] * len(prompts)
        left = list(range(len(prompts)))
        for _ in range(times):
            if not left:
                break
            try:
                got = generate([prompts[i] for i in left])
            except Exception:  # a model that fails counts as silent
                continue
            for i, g in zip(left, got):
                out[i] = g or ""
            left = [i for i in left if not out[i].strip()]
        return out

    return run


def _batch(f, kind: str, arity: int) -> Callable[..., Column]:
    if arity == 1:

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series(f([x or "" for x in b]))

    else:

        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for a, b in batches:
                yield pd.Series(f([x or "" for x in a], [x or "" for x in b]))

    run.__annotations__ = {"batches": Iterator[pd.Series] if arity == 1 else Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def embedder(f: Callable = embed_double) -> Callable[..., Column]:
    return _batch(f, "array<double>", 1)


def scorer(f: Callable = score_double) -> Callable[..., Column]:
    return _batch(f, "double", 2)


def generator(f: Callable = generate_double) -> Callable[..., Column]:
    return _batch(retrying(f), "string", 1)


REGISTRY: dict[tuple[str, str], Callable] = {("embedding", "double"): embedder, ("reranker", "double"): scorer, ("llm", "double"): generator}


def create(kind: str, name: str, *args):
    """The registered hook, or None for an unknown name."""
    make = REGISTRY.get((kind, name))
    return make(*args) if make else None
