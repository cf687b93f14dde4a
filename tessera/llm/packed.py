"""Exchanging hashes of whole corpora in packed blocks.

Documents are packed into chunks of bounded size (compressed blobs, so texts cross a shuffle once and small). Each
chunk sorts its hashes and sends one sorted, delta-coded block per hash bucket; a bucket merges the blocks of all
chunks and answers with one value per entry; answers meet their chunk again. A hash that is frequent in a chunk is
one entry there, so no key makes a bucket hot, and every task's memory is bounded by the chunk and bucket sizes.

Where chunks or buckets are more than FAN, blocks pass through several exchanges: the first deals a chunk's hashes to FAN
ranges of buckets, the next merges the blocks that FAN chunks sent to a range and deals them to FAN parts of it, and
so on; answers return the same way. FAN is then lowered as far as the same number of exchanges allows: a range gets FAN
blocks of a FANth of a chunk's hashes each, about what one chunk has. Each exchange has some chunks times FAN blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import texts

#: Bytes of text in a chunk, and about as many hashes in a bucket as a quarter of it in bytes.
CHUNK_BYTES = 8 << 20
#: Cut points that the driver holds at most when documents are dealt in order of their ids.
CUT_POINTS = 8192
#: Blocks that a chunk sends and a bucket gets in one exchange. More chunks or buckets take more exchanges.
FAN = 256
NULL_ID = 2**63 - 1


def put(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit integers as byte planes of their differences."""
    d = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    n = (int(d.max()).bit_length() + 7) // 8 if len(d) else 0
    return len(d).to_bytes(4, "little") + bytes([n]) + np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def get(raw: bytes) -> np.ndarray:
    n, planes = int.from_bytes(raw[:4], "little"), raw[4]
    d = np.zeros((n, 8), np.uint8)
    d[:, :planes] = np.frombuffer(raw, np.uint8, n * planes, 5).reshape(planes, n).T
    return np.cumsum(d.reshape(-1).view("<u8"), dtype=np.uint64)


def put_small(values: np.ndarray) -> bytes:
    """Unsigned integers, mostly small, as byte planes."""
    v = values.astype("<u8")
    n = (int(v.max()).bit_length() + 7) // 8 if len(v) else 0
    return bytes([n]) + np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def get_small(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : raw[0]] = np.frombuffer(raw, np.uint8, n * raw[0], 1).reshape(raw[0], n).T
    return out.reshape(-1).view("<u8")


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Rising with the key, so that blocks in order of their bucket hold keys in order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def split_by_bucket(keys: np.ndarray, buckets: int, width: int = 1) -> list[tuple[int, int, int]]:
    """(range, from, to) of the ranges of width buckets that sorted keys fall in."""
    b = bucket_of(keys, buckets) // np.uint64(width)
    edges = np.flatnonzero(np.diff(b)) + 1
    starts = np.concatenate([[0], edges]) if len(keys) else edges
    return [(int(b[s]), int(s), int(e)) for s, e in zip(starts, [*edges, len(keys)])]


def widths(chunks: int, buckets: int, fan: int = FAN) -> list[int]:
    """Buckets in a range, by exchange: one in the last."""
    n = 1
    while fan**n < max(chunks, buckets):
        n += 1
    return [fan ** (n - 1 - k) for k in range(n)]


def evened(chunks: int, buckets: int, fan: int = FAN) -> int:
    """The least fan that needs no more exchanges. With a larger one the first exchange has few ranges, and each gets the
    blocks of many senders: at 768 chunks and a fan of 256 a third of 256 chunks at once."""
    n, even = len(widths(chunks, buckets, fan)), 2
    while even**n < max(chunks, buckets):
        even += 1
    return even if n > 1 else fan


def exchanged(first: DataFrame, widths: list[int], fan: int, forward: Callable, answer: Callable[[DataFrame], DataFrame], back: Callable, blocks: str, answers: str) -> DataFrame:
    """The answers to a chunk's blocks, through as many exchanges as widths.

    first: blocks (bucket: range of buckets, chunk: sender, and others) of the first exchange. forward(width) makes, of
    the blocks that fan senders sent to a range, the merged blocks for its parts; answer makes the answers of the last
    exchange; back(width) makes, of what a range got and the answers to what it forwarded, the answers to its senders. Answers
    name the block: bucket, chunk."""
    group = F.floor(F.col("chunk") / fan).cast("int").alias("group")
    steps = [first]
    for width in widths[1:]:
        steps.append(steps[-1].groupBy("bucket", group).applyInArrow(forward(width), blocks))
    got = answer(steps[-1])
    for sent, width in reversed(list(zip(steps[:-1], widths[1:]))):
        wide = F.floor(F.col("bucket") / fan).cast("int").alias("wide")
        got = sent.groupBy("bucket", group).cogroup(got.groupBy(wide, "chunk")).applyInArrow(back(width), answers)
    return got


def text_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text."""
    r = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return int(r[0]), int(r[1] or 0)


def in_order(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[Callable[[np.ndarray], np.ndarray], int, int]:
    """A function from ids to chunks that rises with the id, the number of chunks and the bytes of text.

    Chunks are runs of bins between quantiles of the ids, merged up to chunk_bytes. A bin of more than that (of more text than
    CUT_POINTS chunks) is cut into parts of equal widths of ids. Rows of one id share a chunk."""
    rows, total = text_bytes(docs)
    want = max(1, min(CUT_POINTS, 8 * total // chunk_bytes, rows))
    q = docs.agg(F.percentile_approx("doc_id", [i / want for i in range(1, want)] or [0.5], 10_000)).first()[0] or []
    cuts = np.unique(np.array(q, np.int64)) if want > 1 else np.empty(0, np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, lo, hi = np.zeros(len(cuts) + 1, np.int64), np.full(len(cuts) + 1, NULL_ID), np.full(len(cuts) + 1, -NULL_ID - 1)
        for b in batches:
            ids, size = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = np.searchsorted(cuts, ids, side="left")
            w += np.bincount(at, size, len(w)).astype(np.int64)
            known = ids != NULL_ID
            np.minimum.at(lo, at[known], ids[known])
            np.maximum.at(hi, at[known], ids[known])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (at, w[at], lo[at], hi[at])], names=["bin", "size", "lo", "hi"])

    sizes = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("double").alias("size"))
    bins = sizes.mapInArrow(weigh, "bin long, size long, lo long, hi long").groupBy("bin").agg(F.sum("size").alias("size"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    got = {r["bin"]: r for r in bins.collect()}  # CUT_POINTS rows at most
    # per bin its first chunk, how many chunks it is cut into, its least id and the ids in each
    chunk, run, deal = 0, 0, np.zeros((4, len(cuts) + 1), np.int64)
    deal[1], deal[3] = 1, 1
    for i in range(len(cuts) + 1):
        w, lo, hi = (got[i]["size"], got[i]["lo"], got[i]["hi"]) if i in got else (0, 0, 0)
        parts = min(-(-w // chunk_bytes), max(hi - lo + 1, 1)) if want == CUT_POINTS and w > chunk_bytes else 1
        if run and run + w > chunk_bytes:
            chunk, run = chunk + 1, 0
        deal[:, i] = chunk, parts, min(lo, hi), -(-max(hi - lo + 1, 1) // parts)
        chunk, run = chunk + parts - 1, run + w

    def of(ids: np.ndarray) -> np.ndarray:
        first, parts, lo, step = deal[:, np.searchsorted(cuts, ids, side="left")]
        past = np.maximum(ids, lo).view(np.uint64) - lo.view(np.uint64)
        return (first + np.minimum(past // step.view(np.uint64), (parts - 1).view(np.uint64)).view(np.int64)).astype(np.int32)

    return of, chunk + 1, total


def by_hash(total_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> tuple[Callable[[np.ndarray], np.ndarray], int]:
    n = max(1, -(-total_bytes // chunk_bytes))

    def chunk(ids: np.ndarray) -> np.ndarray:
        from .words import mix64

        return (mix64(ids.astype(np.uint64) + np.uint64(1)) % np.uint64(n)).astype(np.int32)

    return chunk, n


def pack(docs: DataFrame, chunk: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """docs: doc_id, text -> chunk, blob: compressed ids and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            body = texts(batch.column(1))
            where = chunk(ids)
            order = np.argsort(where, kind="stable")
            out_c, out_b = [], []
            for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
                if len(part):
                    out_c.append(int(where[part[0]]))
                    out_b.append(z.compress(pickle.dumps((ids[part], [body[i] for i in part.tolist()]), 5)))
            yield pa.RecordBatch.from_arrays([pa.array(out_c, pa.int32()), pa.array(out_b, pa.binary())], names=["chunk", "blob"])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text").mapInArrow(run, "chunk int, blob binary")


def unpack(blobs: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a chunk, in order of id, then text."""
    z, rows = zstandard.ZstdDecompressor(), []
    for b in blobs["blob"].to_pylist():
        rows += zip(*(x.tolist() if isinstance(x, np.ndarray) else x for x in pickle.loads(z.decompress(b))))
    rows.sort()
    return np.array([r[0] for r in rows], np.int64), [r[1] for r in rows]


def ids_out(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)
