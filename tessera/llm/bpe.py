"""Byte-level BPE encoding and decoding in two tiers.

A minimal perfect hash (hash and displace: one slot per vocabulary entry, one displacement per small bucket)
resolves pre-tokens that are vocabulary entries; all others are merged by a heap over linked bytes: the lowest
rank first, the leftmost of equals first. Resolved pre-tokens are remembered per worker up to a fixed number.

The vocabulary is a file of "base64 rank" lines, read by the driver and broadcast; its size is checked.

Defined results: null texts encode as empty ones; empty texts give no ids; repeated rows and ids are kept;
special tokens don't exist; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Vocabulary files larger than this are refused, because they are broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pre-tokens remembered per Python worker, some 200 bytes each.
REMEMBERED = 400_000
_M64, _A, _B = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file of 'base64 rank' lines."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    pairs = [line.split() for line in raw.splitlines() if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """A minimal perfect hash over keys: slot(key) is a bijection from the keys to range(len(keys))."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, n)
        where = (h >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.argsort(where, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(where[order])) + 1)
        free, self.shift = np.ones(n, bool), [0] * self.buckets
        tries = np.arange(64, dtype=np.uint64)
        for group in sorted(groups, key=len, reverse=True):
            b = int(where[group[0]])
            if len(group) == 1:
                break
            base = 0
            while True:
                slots = self._slots(h[group][None, :], (tries + np.uint64(base))[:, None])
                s = np.sort(slots, axis=1)
                good = np.flatnonzero(free[slots].all(axis=1) & (s[:, 1:] != s[:, :-1]).all(axis=1))
                if len(good):
                    free[slots[good[0]]] = False
                    self.shift[b] = base + int(good[0])
                    break
                base += len(tries)
        rest = iter(np.flatnonzero(free).tolist())
        for group in groups:
            if len(group) == 1:  # a lone key takes any free slot, stored as a negative number
                self.shift[int(where[group[0]])] = -1 - next(rest)
        self.key_at: list[int] = [0] * n
        for i, k in enumerate(keys):
            self.key_at[self.slot(k)] = i

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (((h ^ (d * np.uint64(_A))) * np.uint64(_B)) >> np.uint64(32)).astype(np.int64) % self.n

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[(h >> 32) % self.buckets]
        return -1 - d if d < 0 else ((((h ^ ((d * _A) & _M64)) * _B) & _M64) >> 32) % self.n

    def find(self, key: bytes, keys: list[bytes]) -> int:
        """The index of key in keys, or -1."""
        i = self.key_at[self.slot(key)]
        return i if keys[i] == key else -1


class Bpe:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.whole = PerfectHash(tokens)

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern, "whole": self.whole}

    def __setstate__(self, state):
        self.__dict__.update(state)

    @property
    def split(self):
        if "_split" not in self.__dict__:
            self._split = regex.compile(self.pattern)
            self._ranks = {t: i for i, t in enumerate(self.tokens)}
            self._seen = _Remembered(self)
        return self._split.findall

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no vocabulary entry: a heap of pairs over a linked list of parts."""
        ranks, n = self._ranks, len(piece)
        after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if stop[i] else n
            if j >= n or stop[j] != end:  # one of the two parts has changed since
                continue
            stop[i], k = end, after[j]
            stop[j], after[i] = 0, k
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : stop[k]])) is not None:
                    heapq.heappush(heap, (r, i, stop[k]))
            p = before[i]
            if p >= 0 and (r := ranks.get(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : stop[i]]])
            i = after[i]
        return out

    def pre_token(self, piece: bytes) -> list[int]:
        i = self.whole.find(piece, self.tokens)
        return [i] if i >= 0 else self.merge(piece)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self.split(text)
        return b"".join(map(self._seen.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Remembered(dict):
    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        raw = piece.encode()
        out = np.array(self.bpe.pre_token(raw), "<u4").tobytes()
        if len(raw) <= 256:
            self[piece] = out
        return out


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Bpe:
    return Bpe(read_ranks(path), pattern)


#: What a pass makes of a row, by name.
_WORK = {
    "encode": lambda bpe, v: (bpe.encode(v or ""),),
    "decode": lambda bpe, v: (v, bpe.decode(v or b"")),
    "both": lambda bpe, v: ((ids := bpe.encode(v or "")), bpe.decode(ids)),
}


def _map(df: DataFrame, bpe: Bpe, column: str, work: str, *out: str) -> DataFrame:
    """df's doc_id and column -> doc_id and the columns out; texts go row by row, batches stay small."""
    shared = df.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _WORK[work]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                done = zip(*(f(shared.value, v) for v in part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.binary()) for x in done)], names=["doc_id", *out])

    return df.select(F.col("doc_id").cast("long"), column).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} binary" for c in out))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, ids (packed little-endian unsigned 32-bit integers)."""
    return _map(docs, load(path, pattern), "text", "encode", "ids")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded: doc_id, ids. Returns doc_id, ids, decoded (bytes)."""
    return _map(encoded, load(path, pattern), "ids", "decode", "ids", "decoded")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, ids, decoded (bytes, from the ids): encode and decode in one pass."""
    return _map(docs, load(path, pattern), "text", "both", "ids", "decoded")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_tokens, ids_sha256, decoded_sha256."""
    back = round_trip(docs, path, pattern)
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), *default_vocabulary())
