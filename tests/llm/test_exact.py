"""Exact deduplication against a plain loop: several batches, a restart, nulls, ties, clashing digests, hot groups."""

from __future__ import annotations

import hashlib
import string
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TEXTS = ["One text.", "one TEXT.", "ÉTÉ", "été", "Été", "", None, " ", "x" * 300_000, "X" * 300_000, "y"]


def plain(rows):
    """(doc_id, text) -> sorted (doc_id, keep_id, group_size, digest) and the number kept."""
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    low = lambda i: -(2**63) if i is None else i
    return sorted(((i, max(groups[(t or "").translate(LOWER)], key=low), len(groups[(t or "").translate(LOWER)]), hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()) for i, t in rows), key=str), len(groups)


def found(df):
    got = df.select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("d"), "kept").collect()
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.d) for r in got), key=str), sum(r.kept for r in got)


@pytest.fixture
def home(tmp_path):
    return f"{tmp_path}/state-{uuid.uuid4()}"


def add(spark, rows, path):
    # a column of a name that the operator uses, and one that it doesn't know
    spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, n string, digest int").coalesce(1).write.mode("append").parquet(path)


def test_batches_and_restart(spark, tmp_path, home):
    path = f"{tmp_path}/documents.parquet"
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(40)] + [(None, "y"), (None, "only here"), (7, TEXTS[7]), (7, TEXTS[7])]
    for k in range(3):
        add(spark, rows[k::3], path)
    exact.ingest(spark, path, home, options={"maxFilesPerTrigger": "1"})
    assert found(exact.decide(spark.read.parquet(path), exact.known(spark, home))) == plain(rows)
    more = [(1000, "one text."), (1001, "new"), (-5, None)]
    add(spark, more, path)
    exact.ingest(spark, path, home)
    exact.ingest(spark, path, home)  # nothing new: nothing counted twice
    assert found(exact.decide(spark.read.parquet(path), exact.known(spark, home))) == plain(rows + more)


def test_clashing_digests_and_hot_groups(spark, tmp_path, home, monkeypatch):
    monkeypatch.setattr(exact, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(exact, "HOT_SHARE", 0.2)
    monkeypatch.setattr(exact, "COPIES", 4)
    weak = lambda t: F.substring(F.unhex(F.sha2(t.cast("binary"), 256)), 1, 1)
    path = f"{tmp_path}/documents.parquet"
    rows = [(i, f"text {i}") for i in range(600)] + [(2000 + i, "hot") for i in range(400)] + [(5000 + i, f"text {i % 50}") for i in range(200)]
    add(spark, rows, path)
    exact.ingest(spark, path, home, weak)
    got = exact.decide(spark.read.parquet(path), exact.known(spark, home), weak).collect()
    want, groups = plain(rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == sorted(w[:3] for w in want)
    assert sum(r.kept for r in got) == groups


def test_empty(spark, tmp_path, home):
    path = f"{tmp_path}/documents.parquet"
    add(spark, [], path)
    exact.ingest(spark, path, home)
    assert exact.decide(spark.read.parquet(path), exact.known(spark, home)).count() == 0


def test_settings_come_back(spark):
    key = "spark.sql.streaming.stateStore.unloadOnCommit"
    before = spark.conf.get(key, None)
    with exact.settings(spark, {key: "true"}):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) == before
