"""States as other generators draw them, and tolerant parsers, as Arrow functions."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType


def twister_item(name: Column, words: int) -> Column:
    """State of a name drawn by a Mersenne twister seeded with the first four bytes of md5(lower(name)):
    a uniform number above 0.5 is +1, so its bit is clear. Null for a null name."""
    @F.pandas_udf(ArrayType(LongType()))
    def draw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[int]] = {}
        weights = np.left_shift(np.int64(1), np.arange(32))
        for names in batches:
            out = []
            for n in names:
                if n is not None and n not in known:
                    if len(known) >= 100_000:
                        known.clear()
                    seed = int.from_bytes(hashlib.md5(n.lower().encode()).digest()[:4], "little")
                    minus = np.random.RandomState(seed).rand(32 * words) <= 0.5
                    known[n] = (minus.reshape(words, 32) * weights).sum(axis=1).tolist()
                out.append(None if n is None else known[n])
            yield pd.Series(out)

    return draw(name)


def gaussian_state(vector: Column, dim: int, words: int, seed: int = 42) -> Column:
    """Bits of a vector projected on a seeded Gaussian matrix: set where the projection is 0 or more.
    Null for a null vector or one of another length."""
    @F.pandas_udf(ArrayType(LongType()))
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matrix = np.random.RandomState(seed).randn(dim, 32 * words).astype(np.float32)
        weights = np.left_shift(np.int64(1), np.arange(32))
        for vectors in batches:
            ok = vectors.map(lambda v: v is not None and len(v) == dim)
            out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
            if ok.any():
                bits = np.stack(vectors[ok].to_list()).astype(np.float32) @ matrix >= 0
                packed = (bits.reshape(-1, words, 32) * weights).sum(axis=2)
                out[ok] = pd.Series(list(packed), index=vectors.index[ok])
            yield out

    return project(vector)


def json_objects(text: Column, key: str) -> Column:
    """Texts of all JSON objects in a text that have ``key``, outermost ones only; what is no valid
    object is skipped."""
    @F.pandas_udf(ArrayType(StringType()))
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        read = json.JSONDecoder().raw_decode
        for texts in batches:
            out = []
            for t in texts:
                found, at = [], -1 if t is None else t.find("{")
                while at >= 0:
                    try:
                        value, end = read(t, at)
                        if isinstance(value, dict) and key in value:
                            found.append(t[at:end])
                    except (ValueError, RecursionError):
                        end = at + 1
                    at = t.find("{", end)
                out.append(found)
            yield pd.Series(out)

    return find(text)


def npy_values(content: Column) -> Column:
    """Values of the bytes of a .npy file, flattened; null for anything else."""
    @F.pandas_udf(ArrayType(DoubleType()))
    def load(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for blobs in batches:
            out = []
            for b in blobs:
                try:
                    out.append(np.load(io.BytesIO(b), allow_pickle=False).astype(float).ravel())
                except (ValueError, TypeError, EOFError):
                    out.append(None)
            yield pd.Series(out)

    return load(content)
