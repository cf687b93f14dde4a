"""Embedding providers: what a task needs to ask one for the vectors of a partition's texts.

A provider takes a list of texts and gives as many vectors. A request that is too large is halved, one that fails for a while is repeated;
a single text that is too large keeps a null vector and its error, so that it costs nobody else's."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Provider = Callable[[list[str]], list[list[float]]]


class TooLarge(Exception):
    """A request that the provider would never take in one piece."""


class Unavailable(Exception):
    """A failure that may pass."""


def spans(count: int, width: int) -> list[tuple[int, int]]:
    """Requests of fixed width."""
    return [(a, min(a + width, count)) for a in range(0, count, width)]


def asked(provider: Provider, texts: list[str], dim: int, tries: int = 4, wait: float = 0.5) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text."""
    for k in range(tries):
        try:
            vectors = provider(texts)
        except TooLarge as e:
            if len(texts) == 1:
                return [(None, f"too large: {e}")]
            half = (len(texts) + 1) // 2
            return asked(provider, texts[:half], dim, tries, wait) + asked(provider, texts[half:], dim, tries, wait)
        except Unavailable:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
        else:
            if len(vectors) != len(texts) or any(len(v) != dim for v in vectors):
                raise ValueError(f"the provider must give {len(texts)} vectors of {dim} dimensions")
            return [(v, None) for v in vectors]
    return []


def embedded(rows: DataFrame, provider: Provider, dim: int, width: int = 64, tries: int = 4, wait: float = 0.5) -> DataFrame:
    """rows (chunk_id, content_hash, text) with embedding and error in place of text. Partitions ask side by side; repartition() bounds how
    many do."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in ("chunk_id", "content_hash")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            got = [x for a, b in spans(len(texts), width) for x in asked(provider, texts[a:b], dim, tries, wait)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v for v, _ in got], pa.list_(pa.float64())), pa.array([e for _, e in got], pa.string())], names=["chunk_id", "content_hash", "embedding", "error"])

    return rows.select("chunk_id", "content_hash", "text").mapInArrow(run, f"chunk_id {kinds['chunk_id']}, content_hash {kinds['content_hash']}, embedding array<double>, error string")
