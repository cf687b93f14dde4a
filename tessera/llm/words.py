"""Vectorised words: hashes of the words of whole texts, remembered per Python worker up to a bound."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words remembered per Python worker before the memory starts anew, some 150 bytes each.
REMEMBERED = 50_000
#: Bytes of text whose Python objects and arrays a worker holds at once; a batch has thousands of rows, whatever their length.
PORTION_BYTES = 2 << 20


class WordHash(dict):
    """word (bytes) -> 64-bit hash; a dict, so that map() looks words up without Python frames."""

    def __init__(self, f: Callable[[bytes], int] = xxhash.xxh3_64_intdigest):
        self.f = f

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self.f(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty. bytes.split() then splits at exactly 0x20 and 0x09-0x0D."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def portions(column: pa.Array, most: int = PORTION_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(position of the first, texts) of consecutive runs of at most so many bytes, and a text that passes them."""
    past = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(past)) + 1).tolist(), len(column)]
    for start, end in zip(edges, edges[1:]):
        if end > start:
            yield start, texts(column.slice(start, end - start))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(x: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of the n consecutive words from each position; x has the word hashes of one text."""
    m = len(x) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    r = np.random.default_rng([n, seed]).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = x[:m] * r[0]
    for k in range(1, n):
        out += x[k : k + m] * r[k]
    return mix64(out)
