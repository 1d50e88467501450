"""Words of whole texts and their hashes, for code that runs inside tasks.

Texts are handled as UTF-8 bytes: ``bytes.split`` splits exactly at the blanks U+0020 and U+0009 to
U+000D, and ``bytes.lower`` changes A-Z alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words kept in a task's table of hashes before it is emptied; bounds the memory of a Python worker.
CACHE_WORDS = 300_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHashes(dict):
    """64-bit hashes of words, each computed once while the table lasts."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        """Hashes of ``words`` in order."""
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    z = values + _ODD
    z = (z ^ (z >> np.uint64(30))) * _MIX[0]
    z = (z ^ (z >> np.uint64(27))) * _MIX[1]
    return z ^ (z >> np.uint64(31))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, scrambled; the whole sequence as one where it is shorter."""
    width = min(width, len(hashes))
    if width == 0:
        return np.zeros(0, np.uint64)
    n = len(hashes) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = mixed(out ^ hashes[i : i + n])
    return out


def byte_texts(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column, row by row, without decoding."""
    view = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    for value in view:
        yield value.as_py()


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return values.view(np.int64)


def flat_lists(values: np.ndarray, lengths: list[int] | np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from its concatenated values."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
