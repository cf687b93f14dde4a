"""Requests to embedding providers, and pages with totals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import providers
from tessera.operators import ranking
from tessera.plans import corpus


def test_spans():
    assert providers.spans(5, 2) == [(0, 2), (2, 4), (4, 5)] and providers.spans(0, 3) == []


def test_halving_and_retries():
    calls = []

    def provider(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise providers.Unavailable
        if sum(map(len, texts)) > 10:
            raise providers.TooLarge(sum(map(len, texts)))
        return [[float(len(t)), 0.0] for t in texts]

    got = providers.asked(provider, ["aaaa", "bbbb", "c" * 50, "dd", ""], 2, wait=0)
    assert got == [([4.0, 0.0], None), ([4.0, 0.0], None), (None, "too large: 50"), ([2.0, 0.0], None), ([0.0, 0.0], None)] and calls[:3] == [5, 5, 3]
    with pytest.raises(providers.Unavailable):
        providers.asked(lambda t: (_ for _ in ()).throw(providers.Unavailable()), ["x"], 2, tries=2, wait=0)
    with pytest.raises(ValueError):
        providers.asked(lambda t: [[1.0]], ["x"], 2)


def test_backfill_through_a_provider(spark):
    chunks = spark.createDataFrame([(i, "x" * i) for i in range(20)], "chunk_id long, text string").repartition(3)

    def provider(texts):
        if len(texts) > 3 or max(map(len, texts)) > 15:
            raise providers.TooLarge("limit")
        return [[float(len(t))] for t in texts]

    rows = corpus.backfilled(chunks, spark.createDataFrame([], "chunk_id long, content_hash string"), dim=1, provider=provider).collect()
    assert {r.chunk_id: r.embedding for r in rows} == {i: [float(i)] if i < 16 else None for i in range(20)}
    assert {r.chunk_id for r in rows if r.error} == {16, 17, 18, 19}


def test_pages_with_totals(spark):
    rows = spark.range(7)
    got = [tuple(r) for r in ranking.counted_page(rows, [F.desc("id")], 3, 2).collect()]
    assert got == [(4, 7), (3, 7), (2, 7)] and ranking.counted_page(rows, [F.col("id")], 3, 9).count() == 0
    alerts = spark.createDataFrame([(1, 10, 100, "2024-01-01T00:00:00"), (2, 10, 101, "2024-02-01T00:00:00"), (3, 11, 200, "2024-03-01T00:00:00")], "alert_id long, doc_id long, version_id long, captured_at string")
    versions = spark.createDataFrame([(10, 100), (10, 101), (11, 200)], "doc_id long, version_id long")
    digest = sorted((r.alert_id, r.change_kind, r.total) for r in corpus.recent_digest(alerts, versions, "2024-02-01T00:00:00", 1).collect())
    assert digest == [(3, "new", 2)]
