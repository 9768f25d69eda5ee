"""Deterministic feature-hash embeddings: signed hashed tokens, trigrams and token pairs."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: The token pattern and the weights of tokens, their trigrams and adjacent pairs.
TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|\d+|[^\w\s]")
TOKEN_WEIGHT, TRIGRAM_WEIGHT, PAIR_WEIGHT = 1.0, 0.45, 0.65


class HashEmbedder:
    """Embeds texts; the places and weights of a token's features, and of a pair, are memoised per worker."""

    LIMIT = 300_000

    def __init__(self, dimensions: int = 384):
        if dimensions < 32:
            raise ValueError("at least 32 dimensions")
        self.dimensions, self.tokens, self.pairs = dimensions, {}, {}

    def place(self, feature: str) -> tuple[int, float]:
        value = int.from_bytes(blake2b(feature.encode(), digest_size=8).digest(), "little")
        return value % self.dimensions, 1.0 if value >> 63 else -1.0

    def _token(self, t: str):
        got = self.tokens.get(t)
        if got is None:
            padded = f"^{t}$"
            features = [("tok:" + t, TOKEN_WEIGHT)] + [("tri:" + padded[i : i + 3], TRIGRAM_WEIGHT) for i in range(len(padded) - 2)]
            placed = [(*self.place(f), w) for f, w in features]
            got = np.array([p for p, _, _ in placed]), np.array([s * w for _, s, w in placed])
            if len(self.tokens) > self.LIMIT:
                self.tokens.clear()
            self.tokens[t] = got
        return got

    def _pair(self, pair):
        got = self.pairs.get(pair)
        if got is None:
            at, sign = self.place(f"pair:{pair[0]}:{pair[1]}")
            if len(self.pairs) > self.LIMIT:
                self.pairs.clear()
            got = self.pairs[pair] = at, sign * PAIR_WEIGHT
        return got

    def embed(self, text: str) -> np.ndarray:
        found = [t.lower() for t in TOKEN.findall(text)]
        if not found:
            return np.zeros(self.dimensions)
        counts = Counter(found)
        parts = [(*self._token(t), n) for t, n in counts.items()]
        at, weight = [p[0] for p in parts], [p[1] * p[2] for p in parts]
        two = [self._pair(p) for p in pairwise(found)]
        if two:
            places, weights = zip(*two)
            at.append(np.array(places))
            weight.append(np.array(weights))
        out = np.bincount(np.concatenate(at), np.concatenate(weight), self.dimensions)
        norm = np.sqrt((out * out).sum())
        return out / norm if norm else out


def hash_embedding_udf(dimensions: int = 384):
    """Column function text -> array<float>; null texts count as empty (a zero vector)."""
    held: dict = {}

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        e = held.setdefault(dimensions, HashEmbedder(dimensions))
        return pd.Series([e.embed(t or "").astype(np.float32) for t in texts])

    return embed.asNondeterministic()  # so that no plan evaluates it twice
