"""Encoders: text to vector, behind one protocol.

No model's weights are here. ``HashingEncoder`` hashes words and pairs of words into a fixed number of dimensions; it is
deterministic, needs no file, and makes no claim to the quality of a trained model. Any object with ``name``, ``dim``,
``window`` and ``encode`` can take its place: a trained one is loaded once in each Python worker by its ``factory``.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Encoder(Protocol):
    name: str
    dim: int
    window: int

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors, and whether each text was cut to the window."""


def normalise(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay, numbers that aren't finite are refused."""
    if not np.isfinite(x).all():
        raise ValueError("a vector has numbers that aren't finite")
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def pool(hidden: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """One vector from those of tokens: the first one's (``cls``), or the mean of those the mask keeps (``mean``)."""
    if how == "cls":
        return hidden[..., 0, :]
    if how != "mean":
        raise ValueError(f"unknown pooling {how}")
    m = mask[..., None].astype(hidden.dtype)
    return (hidden * m).sum(axis=-2) / np.maximum(m.sum(axis=-2), 1)


class HashingEncoder:
    name = "hashing-64"

    def __init__(self, dim: int = 64, window: int = 512):
        self.dim, self.window = dim, window

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, cut = np.zeros((len(texts), self.dim)), np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            words = (text or "").lower().split()
            cut[i] = len(words) > self.window
            words = words[: self.window]
            for gram in [*words, *map(" ".join, zip(words, words[1:]))]:
                h = zlib.crc32(gram.encode())
                out[i, h % self.dim] += 1 if h >> 31 else -1
        return normalise(out), cut


_loaded: dict[str, Encoder] = {}


def encode_column(text: Column, factory: Callable[[], Encoder] = HashingEncoder, batch: int = 64) -> Column:
    """``struct<embedding array<float>, truncated boolean>``; the encoder is loaded once in a worker."""
    @F.pandas_udf(T.StructType([T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("truncated", T.BooleanType())]))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        key = f"{factory.__module__}.{getattr(factory, '__qualname__', repr(factory))}"
        encoder = _loaded.get(key) or _loaded.setdefault(key, factory())
        for series in texts:
            parts = [encoder.encode([x if x is not None else "" for x in series.iloc[i : i + batch]]) for i in range(0, len(series), batch)]
            v = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, encoder.dim))
            c = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, bool)
            yield pd.DataFrame({"embedding": list(v.astype(np.float32)), "truncated": c})

    return run(text)


# Prefixes that families of models want before documents and queries.
PREFIXES = {"e5": ("passage: ", "query: ")}


def document_text(family: str, text: Column) -> Column:
    return F.concat(F.lit(PREFIXES.get(family, ("", ""))[0]), text)


def query_text(family: str, text: Column) -> Column:
    return F.concat(F.lit(PREFIXES.get(family, ("", ""))[1]), text)


# Architectures whose configuration can be read, and the positions each reserves.
ARCHITECTURES = {"XLMRobertaModel": 2, "BertModel": 0, "ModernBertModel": 0}


def model_config(text: str) -> dict[str, object]:
    """Dimension, layers, heads and window from a model's configuration file."""
    raw = json.loads(text)
    kind = (raw.get("architectures") or [None])[0]
    if kind not in ARCHITECTURES:
        raise ValueError(f"unsupported architecture {kind}")
    return {"architecture": kind, "dim": raw["hidden_size"], "layers": raw["num_hidden_layers"], "heads": raw["num_attention_heads"], "window": raw["max_position_embeddings"] - ARCHITECTURES[kind]}


def find_model(models: DataFrame, name: str) -> DataFrame:
    """Rows of ``models(alias, repo, …)`` for an alias, a repository or its last part."""
    return models.where((F.col("alias") == name) | (F.col("repo") == name) | (F.substring_index("repo", "/", -1) == name))


def quantised(v: Column, block: int = 32) -> Column:
    """The numbers after 8-bit quantisation in blocks: each by its largest magnitude over 127."""
    n = F.ceil(F.size(v) / block).cast("int")
    part = lambda i: F.slice(v, i * block + 1, F.lit(block))

    def one(i):
        scale = F.array_max(F.transform(part(i), lambda x: F.abs(x.cast("double")))) / 127
        return F.transform(part(i), lambda x: F.when(scale > 0, F.rint(x.cast("double") / scale) * scale).otherwise(F.lit(0.0)))

    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), one))
