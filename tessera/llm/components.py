"""Connected components of a link table: the smallest id reachable from each id.

Links are first reduced to a forest within bounded blocks. If one block holds them all, that is the answer; otherwise
large-star and small-star rounds alternate, each cut to the shared folder, until every link points at its smallest id.
Minima are aggregated before they are joined back, and the joins are plain shuffled ones that AQE can split at hubs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links that one task reduces in memory.
BLOCK_LINKS = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, roots) of the links a-b: the smallest id of each id's component, for ids that aren't their own root."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(root, before):
            break
    own = root != np.arange(len(ids))
    return ids[own], ids[root[own]]


def _local(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            ids, roots = forest(*(np.concatenate(p) for p in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], names=["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def components(links: DataFrame, block_links: int = BLOCK_LINKS) -> DataFrame:
    """links: a, b (longs) -> id, component, for the ids that have a smaller one in their component."""
    links = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = links.count()
    while n > block_links:
        # blocks by smaller id keep stars together; each shrinks to a forest
        links = cut(_local(links.repartition(-(-n // block_links), "b")))
        m = links.count()
        if m > 0.8 * n:
            n = m
            break
        n = m
    if n <= block_links:
        return _local(links.repartition(1)).select(F.col("a").alias("id"), F.col("b").alias("component"))
    while True:
        # large star: every neighbour above u is linked to u's smallest neighbour (or u)
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = cut(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        # small star: u and its smaller neighbours are linked to the smallest of them
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select("a", F.col("m").alias("b")))
        new = cut(small.distinct())
        if new.count() == links.count() and new.exceptAll(links).isEmpty():
            return new.select(F.col("a").alias("id"), F.col("b").alias("component"))
        links = new
