"""Exact top-k by inner product: a KD-tree per shard, best-first traversal, and a propagated kth score.

Vectors are hashed into shards of bounded size. A shard's tree splits at the median of its widest dimension and
keeps tight bounding boxes. The largest inner product that a box can give bounds its rows: leaves are visited
best bound first, and the search of a shard ends when the best bound is below the kth score. Queries travel in
blocks; each block first searches one shard, and the kth scores found there start its search of all others.
A block's queries search a tree together: those whose next leaf is the same share one matrix product.

Defined results: vectors that are null, have a null or non-finite component, or a null id take no part; vectors
of another length than the query's aren't compared; a query's own row is told by its id, so rows repeating the
id are left out too, while other repeated vectors each count; ties go to the smaller id; scores are integers
(saturated at the range of long); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS, PRODUCTS, TOGETHER = 4096, 1024, 256, 1 << 18, 8


def finite(v: Column) -> Column:
    """Not null, and every component a finite number."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


class KdTree:
    """Integer vectors under median splits; lo and hi are the tight box of each node."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF_ROWS):
        at, todo = np.arange(len(ids)), [(0, len(ids))]
        self.span, self.kids, lo, hi = [], [], [], []
        parents = [None]
        while todo:
            (a, b), parent = todo.pop(), parents.pop()
            me = len(self.span)
            if parent is not None:
                self.kids[parent].append(me)
            rows = x[at[a:b]]
            self.span.append((a, b))
            self.kids.append([])
            lo.append(rows.min(0))
            hi.append(rows.max(0))
            width = hi[-1].astype(np.float64) - lo[-1].astype(np.float64) if rows.dtype.kind == "i" else hi[-1] - lo[-1]
            if b - a > leaf and width.any():
                mid = (b - a) // 2
                at[a:b] = at[a:b][np.argpartition(rows[:, int(np.argmax(width))], mid)]
                todo += [(a, a + mid), (a + mid, b)]
                parents += [me, me]
        self.lo, self.hi, self.ids, self.x = np.array(lo), np.array(hi), ids[at], x[at]

    def _portions(self, together: list[np.ndarray], nodes: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        """Each leaf's queries, so few at a time that PRODUCTS scores are held: a leaf of equal vectors may be large."""
        for some, node in zip(together, nodes):
            a, b = self.span[node]
            step = max(1, PRODUCTS // (b - a))
            for i in range(0, len(some), step):
                yield some[i : i + step], a, b

    def search(self, qids: np.ndarray, q: np.ndarray, floor: list, k: int) -> Iterator[tuple[int, int, int]]:
        """(position in qids, id, score) of each query's best k at or above its floor.

        All queries go best leaf first at once: in every round each one that isn't done takes its next leaf, and those at
        one leaf share a product. A leaf's bound is that of its box; a query is done when its next bound is below its low."""
        if k <= 0 or not len(qids):
            return
        zero = q.dtype.type(0) if q.dtype != object else 0
        leaves = np.array([n for n, kids in enumerate(self.kids) if not kids])
        bound = np.maximum(q, zero) @ self.hi[leaves].T + np.minimum(q, zero) @ self.lo[leaves].T
        turn = np.argsort(-bound, axis=1, kind="stable")
        least = -np.inf if q.dtype != object else -(2 ** 4096)
        low = np.array([least if f is None else f for f in floor], dtype=q.dtype)
        best_s, best_i = np.full((len(q), k), least, q.dtype), np.full((len(q), k), -1, np.int64)
        going = np.arange(len(q))
        for r in range(len(leaves)):
            leaf = turn[going, r]
            more = bound[going, leaf] >= low[going]
            going, leaf = going[more], leaf[more]
            if not len(going):
                break
            by_leaf = np.argsort(leaf, kind="stable")
            together = np.split(going[by_leaf], np.flatnonzero(np.diff(leaf[by_leaf])) + 1)
            for some, a, b in self._portions(together, leaves[turn[[g[0] for g in together], r]]):
                s = q[some] @ self.x[a:b].T
                s[self.ids[a:b] == qids[some][:, None]] = least
                good = (s >= low[some][:, None]) & (s > least)
                hit = good.any(axis=1)
                if not hit.any():
                    continue
                some, s, good = some[hit], s[hit], good[hit]
                # hits only, packed to the left
                wide = int(good.sum(axis=1).max())
                row, at = np.nonzero(good)
                place = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(good.sum(axis=1))[:-1]]), good.sum(axis=1))
                new_s, new_i = np.full((len(some), wide), least, q.dtype), np.full((len(some), wide), -1, np.int64)
                new_s[row, place], new_i[row, place] = s[row, at], self.ids[a:b][at]
                both_s, both_i = np.concatenate([best_s[some], new_s], axis=1), np.concatenate([best_i[some], new_i], axis=1)
                # the k largest scores, of equals the smaller ids
                keep = np.argsort(both_i, axis=1, kind="stable")
                keep = np.take_along_axis(keep, np.argsort(-np.take_along_axis(both_s, keep, axis=1), axis=1, kind="stable")[:, :k], axis=1)
                best_s[some], best_i[some] = np.take_along_axis(both_s, keep, axis=1), np.take_along_axis(both_i, keep, axis=1)
                low[some] = np.maximum(low[some], best_s[some, -1])
        for i, at in zip(*np.nonzero(best_s > least)):
            yield int(i), int(best_i[i, at]), int(best_s[i, at])


def _matrix(rows: pa.ListArray, scale: float, dim: int) -> np.ndarray:
    """floor(scale * x) as doubles where inner products stay exact in them, else as Python integers."""
    flat = np.floor(scale * np.asarray(rows.flatten(), np.float64)).reshape(len(rows), dim)
    if flat.size and dim * max(1.0, float(np.abs(flat).max())) ** 2 >= 2**52:
        return np.array([[int(v) for v in r] for r in flat.tolist()], dtype=object).reshape(flat.shape)
    return flat


def _packed(m: np.ndarray) -> np.ndarray:
    """Whole doubles in the fewest bytes that hold them, for the way; _joined makes doubles of them again."""
    most = float(np.abs(m).max()) if m.dtype != object and m.size else 0.0
    return m if m.dtype == object else m.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if their products are exact in doubles, else both as Python integers."""
    a, b = (m if m.dtype == object else m.astype(np.float64) for m in (a, b))
    most = lambda m: max((abs(int(v)) for v in (m.min(), m.max())), default=0) if m.size else 0
    if a.dtype == b.dtype == np.float64 and a.shape[1] * max(1, most(a)) * max(1, most(b)) < 2**52:
        return a, b
    whole = lambda m: m if m.dtype == object else np.array([[int(v) for v in r] for r in m.tolist()], dtype=object).reshape(m.shape)
    return whole(a), whole(b)


HITS = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """vectors, queries: vec_id, embedding. Returns query_id, rank, vec_id, score."""
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).withColumn("dim", F.size("embedding"))
    vectors, queries = clean(vectors), clean(queries)
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))

    def plant(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("vec_id")
        ids = group["vec_id"].to_numpy()
        tree = KdTree(ids, _packed(_matrix(group["embedding"].chunk(0), scale, key[1].as_py())))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(tree, 5)], pa.binary())})

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("vec_id")
        ids = group["vec_id"].to_numpy()
        block = (ids, _packed(_matrix(group["embedding"].chunk(0), scale, key[1].as_py())), [None] * len(ids))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()), "rows": pa.array([pickle.dumps(block, 5)], pa.binary())})

    def search(key: tuple, trees: pa.Table, packs: pa.Table) -> pa.Table:
        out = []
        for tree, rows in ((t, r) for t in trees["tree"] for r in packs["rows"]):
            tree = pickle.loads(tree.as_py())
            ids, q, floor = pickle.loads(rows.as_py())
            tree.x, q = _joined(tree.x, q)
            if q.dtype == object:
                tree.lo, tree.hi = (np.array([[int(v) for v in row] for row in m.tolist()], dtype=object).reshape(m.shape) for m in (tree.lo, tree.hi))
            else:
                tree.lo, tree.hi = tree.lo.astype(np.float64), tree.hi.astype(np.float64)
            most = 2**63 - 1
            found = [(int(ids[i]), v, max(-most - 1, min(most, s))) for i, v, s in tree.search(ids, q, floor, k)]
            out.append(pa.table([pa.array(list(c), pa.int64()) for c in (zip(*found) if found else [()] * 3)], names=["query_id", "vec_id", "score"]))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})

    def searched(packs: DataFrame) -> DataFrame:
        """packs: shard, block, dim, rows. A task takes one tree and TOGETHER blocks of its queries at a time."""
        pieces = F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // TOGETHER)))
        keys = ["shard", "dim", "piece"]
        return trees.withColumn("piece", pieces).groupBy(*keys).cogroup(packs.withColumn("piece", F.expr(f"cast(block div {TOGETHER} as int)")).groupBy(*keys)).applyInArrow(search, HITS)

    def raise_floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                ids, q, _ = pickle.loads(batch["rows"][r].as_py())
                low = {x["query_id"]: x["kth"] for x in batch["low"][r].as_py() or []}
                out.append(pickle.dumps((ids, q, [low.get(int(i)) for i in ids]), 5))
            yield pa.RecordBatch.from_arrays([batch["block"], batch["dim"], pa.array(out, pa.binary())], names=["block", "dim", "rows"])

    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    trees = cut(vectors.groupBy(shard.alias("shard"), "dim").applyInArrow(plant, "shard int, dim int, tree binary"))
    asked = cut(queries.groupBy(block.alias("block"), "dim").applyInArrow(pack, "block int, dim int, rows binary"))
    seed = F.pmod(F.col("block"), F.lit(shards))
    first = cut(searched(asked.withColumn("shard", seed)))
    if shards > 1:
        kth = first.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).filter(F.col("n") >= k)
        kth = kth.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int"))
        low = kth.groupBy("block").agg(F.collect_list(F.struct("query_id", "kth")).alias("low"))  # at most a block's queries
        later = asked.join(low, "block", "left").select("block", "dim", "rows", "low").mapInArrow(raise_floor, "block int, dim int, rows binary")
        others = later.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter(F.col("shard") != seed)
        first = first.union(searched(others))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter("vec_id % 50 = 0"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
