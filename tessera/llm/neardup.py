"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector o, rotated at random, is kept as its signs, a bit a dimension, with its correction factor f, the inner
product of the rotated vector with its own code. For another vector q, <code(o), q> / f is an unbiased estimate of <o, q>, whose error for a
pair at the threshold t has a standard deviation of at most sqrt((1 - f^2)(1 - t^2) / (D - 1)) / f. Pairs whose estimate
is within Z deviations of t (or above) are recomputed exactly, in doubles; only they can link.

Every pair is estimated, at every size: the work grows with the square of the distinct vectors. A caller that can do with
less asks for bands by shape: vectors are dealt to bands of random hyperplanes, all pairs of equal band keys meet, counted
in the first band they share, and pairs that share none are lost; plan() has bits and bands by a cost model and a target
recall at the threshold. Buckets are cut into blocks, and pairs of blocks
are the tasks, so a hot bucket is spread. Equal vectors are collapsed first. A task returns link counts and a
forest of its links, not the links.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
vectors of another length; rows of one id count together; a null id links with nothing, has no component and isn't kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lookup, read
from .components import components, forest
from .topk import finite

BLOCK_ROWS, TILE = 16384, 512
#: Deviations of the estimate that are still recomputed, and the recall aimed at for pairs at the threshold.
Z, RECALL = 6.0, 0.999
#: Seconds to estimate a pair of 64 dimensions, and to move a vector.
PAIR_COST, MOVE_COST = 4e-9, 2e-5


def plan(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a band's key, bands) of the least cost; (0, 1) estimates all pairs."""
    best, agree = (0, 1, n * MOVE_COST + n * n / 2 * PAIR_COST), 1 - np.arccos(threshold) / np.pi
    for bits in range(1, 40):
        bands = ceil(log(1 - RECALL) / log(1 - agree**bits))
        cost = bands * (n * MOVE_COST + n * n / 2 / 2**bits * PAIR_COST)
        if cost < best[2]:
            best = (bits, bands, cost)
    return best[0], best[1]


def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]


def band_keys(unit: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """(rows, bands): the signs of bits random hyperplanes per band, as a number."""
    planes = np.random.default_rng([unit.shape[1], bits]).standard_normal((unit.shape[1], bands * bits))
    sign = (unit @ planes > 0).reshape(len(unit), bands, bits).astype(np.int64)
    return sign @ (np.int64(1) << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(unit), bands), np.int64)


class Block:
    """Vectors of a bucket: exact values, packed binary codes of the rotated unit vectors, and their correction factors."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, x: np.ndarray, keys: np.ndarray):
        self.ids, self.weight, self.x, self.keys = ids, weight, x, keys
        turned = self.unit() @ rotation(x.shape[1])
        self.code = np.packbits(turned >= 0, axis=1)
        self.factor = np.abs(turned).sum(1) / np.sqrt(x.shape[1])

    def unit(self) -> np.ndarray:
        wide = self.x.astype(np.float64)
        norm, scale = np.sqrt((wide * wide).sum(1)), np.abs(wide).max(1)
        norm = np.where(np.isfinite(norm) & (norm > 1e-150), norm, scale * np.sqrt(((wide / scale[:, None]) ** 2).sum(1)))
        return wide / norm[:, None]

    def estimators(self, at: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The codes of some rows as vectors whose inner products with rotated vectors are the estimates, and the least
        estimate of each that is still recomputed."""
        d, f = self.x.shape[1], self.factor[at]
        sign = np.unpackbits(self.code[at], axis=1, count=d).astype(np.float32) * 2 - 1
        spread = np.sqrt((1 - np.minimum(f * f, 1)) * (1 - threshold**2) / max(d - 1, 1)) / f
        return sign / (np.sqrt(d) * f)[:, None].astype(np.float32), (threshold - Z * spread - 1e-4).astype(np.float32)


def links_between(a: Block, b: Block, threshold: float, band: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and b of the linked pairs whose first common band this is."""
    out = [np.empty((2, 0), np.int64)]
    ua, ub = a.unit(), b.unit()
    turned = (ub @ rotation(ub.shape[1])).astype(np.float32).T
    for at in range(0, len(a.ids), TILE):
        estimator, least = a.estimators(slice(at, at + TILE), threshold)
        first = at if same else 0  # a pair of one block is met once
        i, j = np.nonzero(estimator @ turned[:, first:] >= least[:, None])
        i, j = i + at, j + first
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 65536):
            p, q = i[k : k + 65536], j[k : k + 65536]
            good = (ua[p] * ub[q]).sum(1) >= threshold
            good &= ~(a.keys[p, :band] == b.keys[q, :band]).any(1)
            out.append(np.stack([p[good], q[good]]))
    return tuple(np.concatenate(out, axis=1))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, shape: tuple[int, int] | None = None) -> DataFrame:
    """vectors: vec_id, embedding -> vec_id, n_links, component_id, kept. shape: bits and bands, which lose links; else all pairs."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = F.col("vec_id").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    able = vectors.filter(usable)
    reps = cut(able.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).withColumn("dim", F.size("embedding")))
    n = reps.count()
    bits, bands = shape or (0, 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = np.asarray(batch["embedding"].take(pa.array(at)).flatten(), np.float64).reshape(len(at), d)
                keys = band_keys(x, bits, bands)
                for band in range(bands):
                    yield pa.RecordBatch.from_arrays([pa.array([band] * len(at), pa.int32()), pa.array(keys[:, band], pa.int64()), *(batch[c].take(pa.array(at)) for c in ("dim", "rep", "weight", "embedding"))], names=["band", "bucket", "dim", "rep", "weight", "embedding"])

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("rep")
        d = key[2].as_py()
        x = np.asarray(rows["embedding"].chunk(0).flatten()).reshape(-1, d)
        block = Block(rows["rep"].to_numpy(), rows["weight"].to_numpy(), x, band_keys(x.astype(np.float64), bits, bands))
        return pa.table({**{n: pa.array([k.as_py()], t) for n, k, t in zip(("band", "bucket", "dim", "block"), key, (pa.int32(), pa.int64(), pa.int32(), pa.int32()))}, "rows": pa.array([pickle.dumps(block, 5)], pa.binary())})

    def compare(key: tuple, pair: pa.Table) -> pa.Table:
        blocks = [pickle.loads(r) for _, r in sorted(zip(pair["block"].to_pylist(), pair["rows"].to_pylist()))]
        a, b = blocks[0], blocks[-1]
        i, j = links_between(a, b, threshold, key[0].as_py(), len(blocks) == 1)
        ids = np.concatenate([a.ids[i], b.ids[j]])
        of, at = np.unique(ids, return_inverse=True)
        count = np.bincount(at, np.concatenate([b.weight[j], a.weight[i]]).astype(float), len(of)).astype(np.int64)
        child, root = forest(a.ids[i], b.ids[j])
        up = of.copy()
        up[np.searchsorted(of, child)] = root
        return pa.table({"rep": pa.array(of, pa.int64()), "links": pa.array(count, pa.int64()), "up": pa.array(up, pa.int64())})

    place = ["band", "bucket", "dim"]
    dealt = reps.mapInArrow(deal, f"band int, bucket long, dim int, rep long, weight long, embedding {vectors.schema['embedding'].dataType.simpleString()}")
    sizes = cut(dealt.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")))
    placed = lookup(dealt, sizes, place, sizes.count())
    blocks = placed.groupBy(*place, F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")).applyInArrow(pack, "band int, bucket long, dim int, block int, rows binary")
    blocks = cut(blocks)
    meets = lookup(blocks, sizes, place, sizes.count()).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.select(*place, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rows")
    met = cut(meets.groupBy(*place, "lo", "hi").applyInArrow(compare, "rep long, links long, up long"))
    counts = met.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(met.filter("rep <> up").select(F.col("rep").alias("a"), F.col("up").alias("b"))).withColumnsRenamed({"id": "rep"})
    found = reps.join(counts, "rep", "left").join(roots, "rep", "left").select("embedding", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    single = found.filter("weight = 1").count() == n
    if single:  # ids are unique: no need to find members by their vectors
        by_id = reps.join(counts, "rep", "left").join(roots, "rep", "left").select(F.col("rep").alias("vec_id"), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
        out = vectors.select("vec_id").join(by_id, "vec_id", "left")
    else:
        rows = vectors.select("vec_id", F.when(usable, F.col("embedding")).alias("embedding"))
        out = rows.join(found.drop("weight"), "embedding", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id WHERE r.root < l.b),
c AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
m AS (SELECT vec_id, min(root) AS root FROM r GROUP BY vec_id)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(m.root, e.vec_id)::BIGINT AS component_id, e.vec_id = coalesce(m.root, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c USING (vec_id) LEFT JOIN m USING (vec_id)
"""
