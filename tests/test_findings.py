"""Rows on which queries once differed from their SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tessera import answer_queries, corpus_queries, join_queries, queries
from tessera.functions import names
from tessera.operators import cells, joins, ranking


def test_exact_quotes_keep_case_and_characters(spark, same, tmp_path):
    """Lower and upper case, ligatures, accents as characters of their own, odd spaces, line-end hyphens."""
    own = [
        "eresnd, eresnd, eresnd, of of of of of of of of of of of", "Of Of Of Of Of Of Of Of Of Of Of Of Of", "the ﬁrst file of the ﬁeld tests and more", "the first file of the field tests and more",
        "0123456789́accent first", "0123456é “quoted” ", "a             b\x0bc ​d", "some re-\n  joined words, and re­ \r\njoined", "", "short", None, "             ", "éééééé é é",
    ]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    got = corpus_queries.quote_match_exact(spark, str(tmp_path))
    same(got, corpus_queries.SQL["quote_match_exact"], str(tmp_path))
    assert {(r["doc_id"], r["quote_of"]): r["exact"] for r in got.filter(F.col("doc_id") < 2).collect()}[0, 1] is False


def test_sql_functions_on_keys_of_seven_digits(spark, same, tmp_path):
    """Keys beyond an application number's six digits, and one whose score lies between two ninth places."""
    keys = [0, 1, 12, 99_999, 640_000, 999_999, *range(1_000_000, 1_000_004), 7_123_456]
    part = spark.createDataFrame([(k, "large ring", "LARGE", "Brand#7") for k in keys], "p_partkey long, p_name string, p_type string, p_brand string")
    part.coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "part.parquet")
    same(join_queries.sql_functions(spark, str(tmp_path)), join_queries.SQL["sql_functions"], str(tmp_path))


def test_fuzzy_cascade_works_names_out_once(spark):
    """What several stages read comes from tables written once: the last plan holds no work on names."""
    last = joins.cascade(*queries.misspelt_catalogue(spark, SF))
    assert names.SEPARATOR not in last._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_hold_few_distances_at_a_time(spark, monkeypatch):
    """A task's distances are bounded whatever the queries and rows, and the neighbours stay the exact ones; ids may repeat or be null."""
    rng = np.random.default_rng(3)
    q, v = (m / np.linalg.norm(m, axis=1)[:, None] for m in (rng.standard_normal((300, 8)), rng.standard_normal((500, 8))))
    most, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *rest, **more: (most.append(a.size), partition(a, *rest, **more))[1])
    monkeypatch.setattr(cells, "TILE", 4_000)
    asked, rows, far = cells.candidates(q, v, pa.array(range(500)), 5)
    assert max(most) <= 4_000 and np.allclose(far, 1 - (q[asked] * v[rows]).sum(axis=1))
    assert {(i, j) for i, j in zip(asked.tolist(), rows.tolist())} == {(i, int(j)) for i in range(300) for j in np.argsort(1 - q[i] @ v.T)[:5]}
    monkeypatch.setattr(ranking, "BLOCK", 100)
    monkeypatch.setattr(ranking, "PACKED", 8 * 90)
    table = spark.createDataFrame([(i % 400 if i else None, x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<double>")
    few = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, query array<double>")
    got = {}
    for r in ranking.top_k_each(table, few, 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["chunk_id"]
    assert got == {i: {n + 1: int(j) % 400 if j else None for n, j in enumerate(np.argsort(1 - q[i] @ v.T)[:5])} for i in range(300)}


def test_trees_meet_several_blocks_without_a_join(spark, monkeypatch):
    """Blocks of queries meet one tree at a time in a group, never a table of all trees; results are the plain ones, equal vectors included."""
    topk = pytest.importorskip("tessera.llm.topk")
    for name, value in {"SHARD_ROWS": 60, "BLOCK_ROWS": 4, "LEAF_ROWS": 8, "PRODUCTS": 16, "TOGETHER": 2}.items():
        monkeypatch.setattr(topk, name, value, raising=False)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 5)) / 4
    x[100:160] = x[7]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # equal keys must meet by their hash
    got = topk.top_k(rows, rows.filter("vec_id % 10 = 0"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join Inner" not in plan
    whole, want = np.floor(256 * x).astype(int), {}
    for i in range(0, 300, 10):
        want |= {(i, n + 1): (j, s) for n, (s, j) in enumerate(sorted(((int(whole[i] @ whole[j]), j) for j in range(300) if j != i), key=lambda c: (-c[0], c[1]))[:5])}
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got.collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == want


@pytest.mark.parametrize("chunks, buckets", [(257, 16), (768, 768), (48, 768), (70_000, 70_000), (3, 9)])
def test_ranges_get_about_one_chunk(chunks, buckets):
    """Where chunks pass through several exchanges, the senders of a range send about one chunk's hashes together."""
    packed = pytest.importorskip("tessera.llm.packed")
    fan = packed.evened(chunks, buckets)
    steps = packed.widths(chunks, buckets, fan)
    assert len(steps) == len(packed.widths(chunks, buckets)) and fan <= packed.FAN
    if len(steps) > 1:
        assert min(fan, chunks) / (max(chunks, buckets) / steps[0]) < 1.2


def test_claim_gate_cleans_a_text_once(spark):
    """Both aggregates read claims that are written once; lines are cut before they are cleaned, and are the first six."""
    got = answer_queries.claim_gate(spark, SF)
    assert "regexp_replace(" not in got._jdf.queryExecution().optimizedPlan().toString()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text}
    want = {}
    for d, t in docs.items():
        want[d // 4] = want.get(d // 4, 0) + min(6, t.count("\n") + 1)
    assert {r.turn_id: r.n for r in got.groupBy("turn_id").agg(F.sum("claims").alias("n")).collect()} == want
