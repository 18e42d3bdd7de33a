"""Embedding of elements and search that joins vectors with the graph."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions import vectors as v
from ..registry import on_graph
from .graph import Graph, checkpoint, top
from .traversal import neighbourhood

#: Texts in, vectors out. A provider is called with batches of at most BATCH.
Provider = Callable[[list[str]], np.ndarray]
BATCH, SIZE = 64, 64


@lru_cache(1 << 16)
def places(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Where a word and its three-letter parts go in a vector, and with what sign; words come again and again."""
    hashes = [zlib.crc32(part.encode()) for part in [word, *(word[i : i + 3] for i in range(len(word) - 2))]]
    return np.array([h % SIZE for h in hashes]), np.array([1.0 if h >> 31 else -1.0 for h in hashes])


def hashing_provider(texts: list[str]) -> np.ndarray:
    """Vectors without a model: signed hashes of words and their three-letter parts, of length one."""
    out = np.zeros((len(texts), SIZE))
    found = [[places(word) for word in text.lower().split()] for text in texts]
    rows = np.repeat(np.arange(len(texts)), [sum(len(at) for at, _ in x) for x in found])
    if len(rows):
        np.add.at(out, (rows, np.concatenate([at for x in found for at, _ in x])), np.concatenate([sign for x in found for _, sign in x]))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def behaviour_text(f: str = "") -> Column:
    return F.concat_ws("\n", f"{f}name", F.when(F.col(f"{f}docstring") != "", F.col(f"{f}docstring")), f"{f}source")


def embedded(rows: DataFrame, text: Column, provider: Provider = hashing_provider, force: bool = False) -> DataFrame:
    """Rows (id, embedding) with vectors where they were missing; empty texts get none. With force all are made anew."""
    have = "embedding" in rows.columns and not force
    rows = rows.select("id", text.alias("text"), (F.col("embedding") if have else F.lit(None).cast("array<double>")).alias("embedding"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = list(batch["embedding"])
            todo = [k for k in range(len(batch)) if out[k] is None and (batch["text"].iloc[k] or "").strip()]
            for at in range(0, len(todo), BATCH):
                part = todo[at : at + BATCH]
                for k, x in zip(part, provider([batch["text"].iloc[k] for k in part]), strict=True):
                    out[k] = x.tolist()
            yield pd.DataFrame({"id": batch["id"], "embedding": out})

    return rows.mapInPandas(run, "id long, embedding array<double>")


def search(g: Graph, vectors: DataFrame, query: str, k: int = 8, depth: int = 1, provider: Provider = hashing_provider) -> DataFrame:
    """(category, id, score): the k elements nearest to the query, then their neighbours in the graph."""
    target = F.array(*(F.lit(float(x)) for x in provider([query])[0]))
    hits = top(vectors.filter("embedding is not null").select("id", v.l2(F.col("embedding"), target).alias("distance")), k, "distance", "id")
    hits = checkpoint(hits.select("id", v.similarity(F.col("distance")).alias("score")))  # k rows that five joins read: all texts are embedded once
    near = neighbourhood(g, hits, depth).select("category", "id", F.lit(None).cast("double").alias("score"))
    return hits.select(F.lit("hit").alias("category"), "id", "score").union(near)


@on_graph()
def embed_functions(g: Graph) -> DataFrame:
    return embedded(g.functions, behaviour_text())


@on_graph()
def embed_names(g: Graph) -> DataFrame:
    return embedded(g.classes, fn.humanised(F.col("name")))


@on_graph()
def hybrid_search(g: Graph) -> DataFrame:
    return search(g, embedded(g.functions, behaviour_text()), "hot bolt promo")
