"""Text vectors from a seeded generator; any ``encode(texts) -> vectors`` can stand in its place."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dimensions, and the generator in ``hash_vector``.
DIMENSIONS = 384


def hash_vector(text: str) -> np.ndarray:
    """Standard normal vector seeded by the text's md5 modulo 2^32, divided by its norm + 1e-8."""
    seed = int(hashlib.md5(text.encode()).hexdigest(), 16) % 2**32
    v = np.random.default_rng(seed).standard_normal(DIMENSIONS).astype(np.float32)
    return v / (np.linalg.norm(v) + 1e-8)


def encoder(preferred: str = "sentence_transformers", model: str = "all-MiniLM-L6-v2") -> Callable[[str], np.ndarray]:
    """The pretrained encoder if its package is installed, else ``hash_vector`` (with a warning)."""
    import importlib
    import logging

    try:
        return importlib.import_module(preferred).SentenceTransformer(model).encode
    except ImportError:
        logging.getLogger("graphloom.embedding").warning("%s is not installed: text vectors come from a seeded generator", preferred)
        return hash_vector


def embed(text: Column, encode: Callable[[str], np.ndarray] = hash_vector) -> Column:
    """array<float> of each text over Arrow batches; null text gives null."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        made = {t: encode(t) for t in set(texts) if isinstance(t, str)}
        return pd.Series([made.get(t) for t in texts], dtype=object)

    return run(text)
