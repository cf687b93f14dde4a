"""Approximate nearest neighbours by an inverted file: cells around centres, several of them probed, candidates ranked by exact cosines.

Centres are fitted on a bounded sample (SAMPLE vectors, by hash of the id); every row is indexed. How many cells a query probes is chosen by
the recall that some of the queries reach against brute force within the sample; with all cells probed the result is exact. Cells of more
than PART rows are split, queries go in blocks of BLOCK, so a task holds one part and one block.

Null, empty and zero vectors, vectors with null or non-finite components and those of another length than the sample's most frequent
one are in no result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import score
from ..tables import cut, small

#: Vectors that the driver fits centres on, rounds of fitting, and queries that recall is measured with.
SAMPLE, ROUNDS, PROBES_FROM = 20_000, 12, 400
PART, BLOCK = 16_384, 4_096


def units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of usable vectors, their unit vectors in doubles)."""
    if pa.types.is_null(column.type) or not len(column):
        return np.zeros(0, np.int64), np.zeros((0, dim))
    at = np.flatnonzero(np.asarray(column.is_valid()) & (np.asarray(column.value_lengths().fill_null(0)) == dim))
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    v = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(at), dim)
    size = np.sqrt((v * v).sum(axis=1))
    good = np.isfinite(size) & (size > 0)
    return at[good], v[good] / size[good, None]


#: Distances that rounding in a matrix product may turn round, and distances that a task holds at a time.
NOISE, TILE = 1e-9, 1 << 21


def candidates(q: np.ndarray, v: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in q, places in v, distances but for rounding) that hold the k nearest of each query, ties by id: of equal vectors the k smallest
    ids, and all that are as near as the k-th but for rounding. Queries go a few at a time, TILE distances or one query's."""
    order = pc.sort_indices(ids).to_numpy(zero_copy_only=False)
    _, same = np.unique(np.ascontiguousarray(v[order]).view(np.dtype((np.void, v.shape[1] * v.itemsize))).reshape(-1), return_inverse=True)
    by_vector = np.argsort(same, kind="stable")
    first = np.concatenate([[0], np.flatnonzero(np.diff(same[by_vector])) + 1])
    nth = np.arange(len(same)) - np.repeat(first, np.diff([*first, len(same)]))
    kept = order[by_vector[nth < k]]
    near, last, step = v[kept].T, min(k, len(kept)) - 1, max(1, TILE // len(kept))
    found = []
    for a in range(0, len(q), step):
        far = 1 - q[a : a + step] @ near
        asked, at = np.nonzero(far <= np.partition(far, last, axis=1)[:, last : last + 1] + NOISE)
        found.append((asked + a, kept[at], far[asked, at]))
    return tuple(np.concatenate(c) for c in zip(*found))


@dataclass
class Index:
    """Centres (unit rows) and the indexed rows: cell, part, id, vector (unit)."""

    centres: np.ndarray
    rows: DataFrame
    parts: DataFrame
    id_: str
    sample: np.ndarray

    def recall(self, k: int, probes: int, asked: np.ndarray | None = None) -> float:
        """Share of the sample's k nearest that queries (unit rows; the sample's own vectors by default) find with so many cells probed."""
        own = asked is None
        asked = self.sample[:PROBES_FROM] if own else asked
        near = asked @ self.sample.T
        if own:
            near[np.arange(len(asked)), np.arange(len(asked))] = -2  # not itself
        k = min(k, len(self.sample) - own)
        if k < 1 or not len(asked):
            return 1.0
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        cell = (self.sample @ self.centres.T).argmax(axis=1)
        rank = (-(asked @ self.centres.T)).argsort(axis=1).argsort(axis=1)
        return float((np.take_along_axis(rank, cell[best], axis=1) < probes).mean())

    def probes_for(self, k: int, recall: float, asked: np.ndarray | None = None) -> int:
        """The fewest probes that reach a recall."""
        low, high = 1, len(self.centres)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.recall(k, mid, asked) >= recall else (mid + 1, high)
        return low


def fitted(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centres by spherical k-means; empty cells take the vectors that fit worst."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:cells]]
    for _ in range(ROUNDS):
        near = sample @ centres.T
        cell = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        size = np.sqrt((sums * sums).sum(axis=1))
        lost = np.flatnonzero(size <= 1e-12)
        sums[lost] = sample[near.max(axis=1).argsort()[: len(lost)]]
        centres = sums / np.sqrt((sums * sums).sum(axis=1))[:, None]
    return centres


def index(rows: DataFrame, cells: int | None = None, id_: str = "chunk_id", vector: str = "embedding") -> Index | None:
    """Indexes all rows; cells: about the square root of their number by default. None without usable vectors."""
    rows = rows.select(id_, F.col(vector).alias("vector"))
    taken = rows.filter("vector is not null").orderBy(F.xxhash64(id_), id_).limit(SAMPLE).toArrow()
    column = taken["vector"].combine_chunks() if taken.num_rows else pa.array([], pa.list_(pa.float64()))
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    lengths, often = np.unique(np.asarray(column.value_lengths()), return_counts=True) if taken.num_rows else ([0], [0])
    dim = int(lengths[np.lexsort((lengths, often))[-1]])
    sample = units(column, dim)[1] if dim else np.zeros((0, 0))
    if not len(sample):
        return None
    n = rows.count()
    centres = fitted(sample, min(len(sample), cells or max(1, round(n**0.5))))
    kind = rows.schema[id_].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, v = units(batch.column(1), dim)
            cell = (v @ centres.T).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(cell), pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), dim).cast(pa.list_(pa.float64()))], names=[id_, "cell", "vector"])

    dealt = cut(rows.mapInArrow(assign, f"{id_} {kind}, cell int, vector array<double>"))
    parts = cut(dealt.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    placed = dealt.join(small(parts, len(centres)), "cell").withColumn("part", F.pmod(F.xxhash64(id_), "parts").cast("int")).drop("parts")
    return Index(centres, placed, parts, id_, sample)


def nearest(found: Index, queries: DataFrame, k: int, probes: int | None = None, recall: float = 0.95) -> DataFrame:
    """queries: query_id, query (vector). query_id, id, rank, distance, score: the k nearest rows of the probed cells, ties by id. probes: cells
    that a query looks into (all of them: exact); by default as many as PROBES_FROM of the queries need for recall on the sample."""
    id_, centres, dim = found.id_, found.centres, found.centres.shape[1]
    if probes is None:
        some = queries.filter("query is not null").orderBy(F.xxhash64("query_id")).limit(PROBES_FROM).select("query").toArrow()["query"].combine_chunks()
        some = some.chunk(0) if isinstance(some, pa.ChunkedArray) and some.num_chunks else some
        probes = found.probes_for(max(k, 1), recall, units(some, dim)[1] if len(some) else np.zeros((0, dim)))
    probes = min(len(centres), probes)
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), id_: found.rows.schema[id_].dataType.simpleString()}

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, v = units(batch.column(1), dim)
            if not len(at):
                continue
            near = np.argpartition(-(v @ centres.T), probes - 1, axis=1)[:, :probes]
            each = pa.array(np.repeat(np.arange(len(at)), probes))
            unit = pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)).take(each), unit.take(each), pa.array(near.reshape(-1).astype(np.int32))], names=["query_id", "query", "cell"])

    def met(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": [], id_: [], "distance": []}
        if rows.num_rows and asked.num_rows and k > 0:
            v, q = (np.asarray(t[c].combine_chunks().flatten()).reshape(t.num_rows, dim) for t, c in ((rows, "vector"), (asked, "query")))
            ids = rows[id_].combine_chunks()
            asked_at, rows_at, _ = candidates(q, v, ids, k)
            # summed in one order whatever the block, so that equal vectors are equally far
            out = {"query_id": asked["query_id"].combine_chunks().take(pa.array(asked_at)), id_: ids.take(pa.array(rows_at)), "distance": pa.array(1 - np.einsum("ij,ij->i", q[asked_at], v[rows_at]))}
        return pa.table(out, schema=pa.schema([("query_id", asked.schema.field("query_id").type), (id_, rows.schema.field(id_).type), ("distance", pa.float64())]))

    n = queries.count()
    blocks = -(-n // BLOCK) or 1
    asked = queries.select("query_id", "query").mapInArrow(probe, f"query_id {kinds['query_id']}, query array<double>, cell int")
    asked = asked.join(small(found.parts, len(centres)), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).drop("parts")
    rows = found.rows if blocks == 1 else found.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumn("block", F.lit(0)) if blocks == 1 else rows
    keys = ["cell", "part", "block"]
    near = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(met, f"query_id {kinds['query_id']}, {id_} {kinds[id_]}, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", id_, "rank", "distance", score(F.col("distance")).alias("score"))
