"""The inverted file against exact neighbours."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import cells, ranking

SCHEMA = "chunk_id long, embedding array<float>"


def exact(vectors, queries, k):
    ids = np.array([i for i, _ in vectors])
    v = np.array([x for _, x in vectors], np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    out = {}
    for i, q in queries:
        d = 1 - v @ (np.array(q) / np.linalg.norm(q))
        out[i] = [int(ids[j]) for j in np.lexsort((ids, d))[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.chunk_id)
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 32))
    vectors = [(i, (centres[i % 30] + rng.standard_normal(32) * 0.7).astype(np.float32).tolist()) for i in range(3000)]
    queries = [(q, rng.standard_normal(32).tolist() if q % 2 else vectors[q * 7][1]) for q in range(40)]
    bad = [(9000, None), (9001, []), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [1.0]), (9005, [None] + [1.0] * 31)]
    df = spark.createDataFrame(vectors + bad, SCHEMA).repartition(4)
    asked = spark.createDataFrame([*queries, (900, None), (901, [0.0] * 32)], "query_id long, query array<double>")
    return vectors, queries, df, asked


def test_all_cells_are_exact(data, monkeypatch):
    vectors, queries, df, asked = data
    monkeypatch.setattr(cells, "PART", 40)  # hot cells in parts
    monkeypatch.setattr(cells, "BLOCK", 16)  # queries in blocks
    found = cells.index(df)
    assert found.rows.count() == len(vectors) and found.parts.agg({"parts": "max"}).first()[0] > 1
    assert got(cells.nearest(found, asked, 8, probes=10**6)) == exact(vectors, queries, 8)


def test_recall(data):
    vectors, queries, df, asked = data
    found = cells.index(df)
    probes = found.probes_for(8, 0.95)
    assert probes < len(found.centres) / 2 and found.recall(8, probes) >= 0.95 > found.recall(8, probes - 1)
    mine, want = got(cells.nearest(found, asked, 8)), exact(vectors, queries, 8)
    assert set(mine) == set(want)
    assert np.mean([len(set(mine[q]) & set(want[q])) / 8 for q in want]) >= 0.9


def test_random_vectors(spark):
    """Without any clusters more cells are probed, and the recall is reached all the same."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id as chunk_id", "embedding")
    asked = rows.filter("chunk_id % 10 = 0").selectExpr("chunk_id as query_id", "embedding as query")
    vectors = [(r.chunk_id, r.embedding) for r in rows.collect()]
    want = exact(vectors, [(i, v) for i, v in vectors if i % 10 == 0], 8)
    mine = got(ranking.approximate(rows, asked, 8))
    assert np.mean([len(set(mine[q]) & set(want[q])) / 8 for q in want]) >= 0.9


def test_nothing_to_index(spark, data):
    empty = spark.createDataFrame([(1, None), (2, [0.0])], SCHEMA)
    assert ranking.approximate(empty, data[3], 3).count() == 0
    assert cells.nearest(cells.index(data[2]), data[3], 0).count() == 0
    assert ranking.approximate(data[2].limit(3), data[3].limit(2), 8).count() == 6


@pytest.mark.parametrize("block", [4096, 7])
def test_exact_neighbours_of_many_queries(spark, data, monkeypatch, block):
    vectors, queries, df, asked = data
    monkeypatch.setattr(ranking, "BLOCK", block)
    monkeypatch.setattr(ranking, "PACK", 700)
    assert got(ranking.top_k_each(df, asked, 8)) == exact(vectors, queries, 8)
    # equal vectors: the smaller id first; a vector of another length meets rows of its own length only
    ties = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(1999, -1, -1)] + [(5000, [3.0]), (5001, None)], SCHEMA).coalesce(1)
    few = spark.createDataFrame([(q, [2.0, 4.0]) for q in range(9)] + [(20, [5.0]), (21, None), (22, [0.0])], "query_id long, query array<double>")
    assert got(ranking.top_k_each(ties, few, 3)) == {q: [0, 1, 2] for q in range(9)} | {20: [5000]}
    assert ranking.top_k_each(ties, few, 0).count() == 0 and ranking.top_k_each(ties.limit(0), few, 3).count() == 0
    assert got(cells.nearest(cells.index(ties), few, 3, probes=99)) == {q: [0, 1, 2] for q in range(9)}
