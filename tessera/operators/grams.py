"""Windows of characters as join keys: hashes of all windows of a text at once, and a bitmap that lets few of them through.

A bitmap of the hashes that are looked for has a fixed size, whatever their number. Texts are scanned with it in their own
partitions; only windows that pass take part in a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap: 512 KB for every scanning task.
BITS = 22
#: An odd number, and its inverse modulo 2^64, of which powers make the hash of a window.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(64)
def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the width characters from each place."""
    n = len(codes)
    if n < width:
        return np.empty(0, np.uint64)
    room = 1 << max(n, 16).bit_length()  # few distinct lengths for the memory of powers
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(BASE, room)[:n])])
    h = (sums[width:] - sums[:-width]) * _powers(INVERSE, room)[: n - width + 1] + np.uint64(width)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def bitmap(grams: DataFrame) -> np.ndarray:
    """grams: gram. Their bitmap: at most 2^BITS numbers reach the driver."""
    bit: Column = F.shiftrightunsigned("gram", 64 - BITS).cast("int")
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in grams.select(bit.alias("bit")).distinct().toLocalIterator():
        out[r["bit"] >> 3] |= 1 << (r["bit"] & 7)
    return out


def passing(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the hashes whose bit is set."""
    bit = h >> np.uint64(64 - BITS)
    return np.flatnonzero((bits[signed(bit >> np.uint64(3))] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)


def scanned(texts: DataFrame, bits: np.ndarray, widths: list[int], form: Callable[[str | None], str], first_only: Callable[[int], bool]) -> DataFrame:
    """texts: two columns, a key and a text -> gram, key, at: places of the windows of form(text) that pass, only the first where a
    width needs no more."""
    key = texts.columns[0]
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, grams, places = [], [np.empty(0, np.int64)], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                codes = codes_of(form(text))
                for width in widths:
                    h = window_hashes(codes, width)
                    hit = passing(h, bits)
                    found, first, count = np.unique(h[hit], return_index=True, return_counts=True)
                    rows += [r] * len(found)
                    grams.append(signed(found))
                    if first_only(width):
                        places += hit[first].reshape(-1, 1).tolist()
                    elif len(found):
                        places += np.split(hit[np.argsort(h[hit], kind="stable")], np.cumsum(count)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["gram", key, "at"])

    return texts.mapInArrow(run, f"gram long, {key} {kind}, at array<int>")


def counted(texts: DataFrame, bits: np.ndarray, widths: list[int], form: Callable[[str | None], str]) -> DataFrame:
    """texts: one column. gram, n: how many texts have each window that passes (counted by batch before the shuffle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.empty(0, np.uint64)]
            for text in batch.column(0).to_pylist():
                codes = codes_of(form(text))
                for width in widths:
                    h = window_hashes(codes, width)
                    each.append(np.unique(h[passing(h, bits)]))
            found, n = np.unique(np.concatenate(each), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
