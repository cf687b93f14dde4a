
from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import names, numbers, sequential, text
from tessera.operators import ranking, sets, windows


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, canonical, stripped",
    [("Metformin Hydrochloride", "metformin hydrochloride", "metformin"), ("B and A", "a; b", "a; b"), ("Sodium Chloride", "sodium chloride", ""), ("X (note), Y", "x; y", "x; y"), (None, "", ""), ("", "", "")],
)
def test_names(spark, raw, canonical, stripped):
    c = F.lit(raw).cast("string")
    assert (one(spark, names.canonical_name(c)), one(spark, names.stripped_name(c))) == (canonical, stripped)


@pytest.mark.parametrize("raw, want", [("NDA 020503", "NDA020503"), ("N20503", "NDA020503"), ("20503", "020503"), ("x", None), ("", None), (None, None)])
def test_application_number(spark, raw, want):
    assert one(spark, names.application_number(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("value, lim, ok", [("0.05%", "NMT 0.1%", True), ("0.2", "NMT 0.1%", False), ("2.4", "NLT 2.5", False), ("1.0", "0.9 - 1.5", True), ("ND", "NMT 1", None), ("1,234", "NLT 1000", True)])
def test_limits(spark, value, lim, ok):
    assert one(spark, numbers.satisfies(numbers.measured(F.lit(value)), numbers.limit(F.lit(lim)))) == ok


def test_shard(spark):
    want = int.from_bytes(hashlib.sha256(b"abc").digest()[:8], "big") % 512
    assert one(spark, numbers.shard(F.lit(" abc "))) == want


def test_citations(spark):
    got = one(spark, text.citations(F.lit("a [PSG_123456, p.2; 020503, p. 3] b [see note]")))
    assert [(r["short_name"], r["page"]) for r in got] == [("PSG_123456", 2), ("020503", 3)]


@pytest.mark.parametrize("quote, page, found, exact", [("the quick brown fox", "so the quick brown fox ran", True, True), ("the dose is 10 mg daily", "the dose is 20 mg daily", False, False), ("", "x", False, False)])
def test_quotes(quote, page, found, exact):
    assert sequential.quote_match(quote, page)[:2] == (found, exact)


def test_mmr_prefers_new_texts():
    assert sequential.mmr([0.9, 0.89, 0.5], ["alpha beta gamma", "alpha beta gamma", "delta epsilon"], 2) == [0, 2]
    assert sequential.mmr([0.9, 0.89, 0.5], ["a a a", "a a a", "b"], 9, 1.0) == [0, 1, 2]


def test_top_k(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, None), (6, [0.0, 0.0])], "chunk_id long, embedding array<double>")
    assert [(r["chunk_id"], r["score"]) for r in ranking.top_k(rows, [1.0, 0.0], 9).collect()] == [(1, 1.0), (2, 1.0), (3, 0.5), (4, 0.0)]
    assert ranking.top_k(rows, [1.0, 0.0], 0).collect() == []


def test_empty_manifest_retires_nothing(spark):
    rows = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(Exception, match="manifest is empty"):
        sets.retired(rows, rows.limit(0), "id").collect()


def test_as_of(spark):
    items = spark.createDataFrame([("d", 1, "a"), ("d", 5, "b"), ("e", 9, "c")], "doc string, at int, name string")
    starts = spark.createDataFrame([("d", 2, "s"), ("d", 5, "t")], "doc string, at int, title string")
    got = windows.assigned_before(items, starts, "doc", "at", "title")
    assert {(r["name"], r["title"]) for r in got.collect()} == {("a", None), ("b", "t"), ("c", None)}
