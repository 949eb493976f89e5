"""Model interfaces and deterministic stand-ins that need no weights."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int
    calibration: tuple[float, float]

    def embed_texts(self, texts: Sequence[str]) -> np.ndarray: ...


class Translator(Protocol):
    def translate(self, text: str) -> str: ...


class TextReader(Protocol):
    def read(self, content: bytes) -> str: ...


class Proposer(Protocol):
    def propose(self, content: bytes) -> list[tuple[list[float], str, float]]: ...


class Detector(Protocol):
    def detect(self, frame_id: str, term: str) -> tuple[list[float], float] | None: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Character trigrams hashed to signed directions; equal texts, equal vectors."""

    dim: int = 64
    calibration: tuple[float, float] = (10.0, 0.0)

    def embed_texts(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, t in zip(out, texts, strict=True):
            t = f"  {' '.join(t.lower().split())} "
            for i in range(len(t) - 2):
                h = int.from_bytes(hashlib.blake2b(t[i : i + 3].encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def embed_images(self, contents: Sequence[bytes]) -> np.ndarray:
        """Pictures are told apart by their bytes; readable ones are embedded as text."""
        return self.embed_texts([c[:4096].decode("utf-8", "replace") for c in contents])

    def embed_column(self, text: Column) -> Column:
        """The same as a column, by Arrow batches."""
        me = self

        @F.pandas_udf("array<double>")
        def embed(texts: pd.Series) -> pd.Series:
            return pd.Series(me.embed_texts(texts.fillna("").tolist()).tolist())

        return embed(text)


class NoTranslator:
    """Returns the text as it is, as every translator does without its model."""

    def translate(self, text: str) -> str:
        return text


def phrase_vector(embedder: Embedder, phrases: Sequence[str]) -> tuple[float, ...]:
    """The unit mean of several phrases' vectors."""
    m = embedder.embed_texts(list(phrases)).mean(axis=0)
    return tuple(float(x) for x in m / max(float(np.linalg.norm(m)), 1e-12))
