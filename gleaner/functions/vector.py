"""Vector functions as columns, and a deterministic embedder for plain text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import bound_batches
from .text import terms


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda t, x: t + x)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda t, x: t + x)


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def slots(words: Column, size: int) -> Column:
    """Places of terms in a hashed vector, from their lengths and three of their characters."""
    at = lambda w, i: F.ascii(F.substring(w, i, F.lit(1)))
    place = lambda w: at(w, F.lit(1)) * 131 + at(w, F.floor(F.length(w) / 2).cast("int") + 1) * 31 + at(w, F.length(w)) * 7 + F.length(w) * 17
    return F.transform(words, lambda w: (place(w) % size).cast("int"))


def word_slots(words: pa.Array, size: int) -> np.ndarray:
    """The same places of words of ASCII letters and digits, none of them empty."""
    words = words.cast(pa.large_string())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    letters = np.frombuffer(words.buffers()[2] or b"", np.uint8).astype(np.int64)
    start, n = ends[:-1], np.diff(ends)
    return (letters[start] * 131 + letters[start + n // 2] * 31 + letters[ends[1:] - 1] * 7 + n * 17) % size


def hashed_vectors(row: np.ndarray, word: np.ndarray, words: pa.Array, n: int, size: int) -> pa.Array:
    """A vector for each of n texts: row and word are the text and the number of each of its terms among words."""
    cells = row * size + word_slots(words, size)[word]
    counts = np.bincount(cells, minlength=n * size).reshape(n, size).astype(float)
    norm = np.sqrt((counts**2).sum(1, keepdims=True))
    vectors = counts / np.where(norm > 0, norm, 1)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(vectors.ravel()))


def coded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of lists of words: the list and the number of each word, and the different words."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = lists.flatten().dictionary_encode()
    return np.repeat(np.arange(len(sizes)), sizes), found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def embed_text(text: Column, size: int = 64, embed: Callable[[list[str], int], list[float]] | None = None) -> Column:
    """A vector for each text from its terms: by default counts of hashed terms, scaled to unit length, with zeros for no terms.

    embed gets a text's terms and the size instead; texts travel in Arrow batches either way.
    """

    def hashed(words: pa.Array) -> pa.Array:
        return hashed_vectors(*coded(words), len(words), size)

    def custom(words: pd.Series) -> pd.Series:
        return pd.Series([embed(list(w), size) for w in words])  # type: ignore[misc]

    bound_batches()
    if embed is None:
        return F.arrow_udf(hashed, "array<double>")(terms(text))
    return F.pandas_udf(custom, "array<double>")(terms(text))
