"""Words of whole batches as 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64
)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, and where each text's words start (one more at the end)."""
    # A copy from offset 0: some string kernels misread slices.
    texts = texts.take(pa.array(np.arange(len(texts))))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), before[ends]


def hash_words(words: pa.Array) -> np.ndarray:
    coded = words.dictionary_encode()
    names = np.array(coded.dictionary.to_pylist(), dtype=object)
    if not len(names):
        return np.zeros(0, dtype=np.uint64)
    return pd.util.hash_array(names, categorize=False)[coded.indices.to_numpy(zero_copy_only=False)]


def shingle_sets(texts: pa.Array, size: int):
    """For each text its sorted distinct shingle hashes (int64) of ``size`` words each.

    A text with fewer words has its whole word sequence as one shingle, a
    text without words has none. Only A-Z are lower-cased.
    """
    words, starts = split_words(texts)
    h = hash_words(words)
    n = max(0, len(h) - size + 1)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        total = mixed(total + _ODD[j % 5]) + h[j : j + n]
    total = mixed(total).view(np.int64)
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= size:
            yield np.unique(total[a : b - size + 1])
        elif b > a:
            one = np.array([b - a], dtype=np.uint64)
            for j in range(a, b):
                one = mixed(one) + h[j]
            yield mixed(one).view(np.int64)
        else:
            yield np.zeros(0, dtype=np.int64)
