"""Every query with SQL gives DuckDB's rows; the rest runs and keeps what its algorithm promises."""

from __future__ import annotations

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tessera import corpus_queries
from tessera import queries as q
from tessera.streaming import queries as streams
from tessera.tables import read


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_matches_sql(spark, same, name):
    same(q.QUERIES[name](spark, SF), q.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(corpus_queries.SQL))
def test_corpus_query_matches_sql(spark, same, name):
    same(corpus_queries.QUERIES[name](spark, SF), corpus_queries.SQL[name], SF)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 8
    assert set(e.oracle_sql()) <= set(e.queries())


def test_chunks_are_parts_of_their_text(spark):
    docs = read(spark, SF, "documents")
    from tessera.plans.retrieval import chunked

    rows = chunked(docs.select("doc_id", F.array(F.coalesce("text", F.lit(""))).alias("pages")))
    assert rows.filter(F.length("text") > 4000).count() == 0
    flat = lambda c: F.regexp_replace(c, r"\s+", "")
    assert rows.join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id").filter(~F.contains(flat(F.col("whole")), flat(F.col("text")))).count() == 0


def test_rate_limit_is_the_plain_loop(spark):
    rows = read(spark, SF, "events").orderBy("ts", "event_id").collect()
    kept, want = {}, {}
    for r in rows:
        mine = [t for t in kept.get(r["user_id"], []) if (r["ts"] - t).total_seconds() < 3600]
        want[r["event_id"]] = len(mine) < 2
        kept[r["user_id"]] = mine + [r["ts"]] * want[r["event_id"]]
    assert {r["event_id"]: r["allowed"] for r in q.rate_limit_exact(spark, SF).collect()} == want


def test_recommended_threshold(spark):
    r = q.threshold_recommend(spark, SF).first()
    curve = {round(x["t"], 2): x for x in q.threshold_curve(spark, SF).collect()}
    floor = curve[0.3]["answer_retention"]
    best = max((x for x in curve.values() if x["answer_retention"] >= floor), key=lambda x: (x["refuse_recall"], -x["t"]))
    assert r["recommended"] == pytest.approx(best["t"])


def test_stream_equals_table(spark, tmp_path):
    events = read(spark, SF, "events")
    events.write.parquet(str(tmp_path / "in"))
    stream = streams.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 hour", "1 hour", "event_type")
    got = streams.finished(stream, "tumbled", str(tmp_path / "cp"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streams.tumbling(events, "1 hour", "1 hour", "event_type").collect()))


def test_top_k_plan_filters_first(spark):
    plan = q.vector_topk_filtered(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "label" in plan.split("PushedFilters")[1]
