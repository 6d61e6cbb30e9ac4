"""An offline stand-in for an embedding model: signed hashing of words."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# What embedding models of this kind want before a text.
PREFIXES = {"query": "search_query: ", "document": "search_document: "}


def hash_vector(text: str, size: int = 64) -> list[float]:
    out = np.zeros(size)
    for word in re.findall(r"\w+", (text or "").lower()):
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest())
        out[h % size] += 1.0 if h >> 63 else -1.0
    length = np.linalg.norm(out)
    return (out / length if length else out).tolist()


def hash_vectors(texts: list[str], size: int = 64) -> np.ndarray:
    """``hash_vector`` of many texts, as rows; a word is hashed once."""
    words = [re.findall(r"\w+", t.lower()) for t in texts]
    numbers: dict[str, int] = {}
    flat = np.array([numbers.setdefault(w, len(numbers)) for ws in words for w in ws], dtype=np.int64)
    hashes = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest()) for w in numbers]
    column = np.array([h % size for h in hashes], dtype=np.int64)
    sign = np.array([1.0 if h >> 63 else -1.0 for h in hashes])
    out = np.zeros((len(texts), size))
    if len(flat):
        np.add.at(out, (np.repeat(np.arange(len(texts)), [len(ws) for ws in words]), column[flat]), sign[flat])
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


def embedding(text: Column, kind: str = "document", size: int = 64) -> Column:
    """Unit vectors of texts; the prefix of the kind is put before each."""
    prefix = PREFIXES[kind]

    @pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hash_vectors([prefix + (t or "") for t in texts], size)))

    return run(text)
