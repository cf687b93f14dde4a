"""Published versions: crashes at every step, two writers, repeated runs, freshness, artifacts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import publish


@pytest.fixture
def table(spark, tmp_path):
    return publish.Table(spark, str(tmp_path / "table"))


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_versions_and_repeats(spark, table):
    assert table.read() is None and table.runs().count() == 0
    assert table.publish(lambda _: spark.range(5), {"id": "first"}) == 0
    assert table.publish(lambda _: spark.range(5).orderBy(F.desc("id"))) == 0  # the same rows
    assert table.publish(lambda now: now.filter("id > 1").union(spark.range(10, 11)), {"id": "second"}) == 1
    assert ids(table.read()) == [2, 3, 4, 10] and ids(table.read(0)) == [0, 1, 2, 3, 4]
    assert [(r.number, r["rows"], json.loads(r.run)["id"]) for r in table.runs().orderBy("number").collect()] == [(0, 5, "first"), (1, 4, "second")]
    assert table.publish(lambda _: spark.range(0)) == 2 and table.read().count() == 0
    assert len(table.vacuumed(1)) == 2 and ids(table.read()) == []


@pytest.mark.parametrize("step", ["build", "write", "digest", "put", "rename"])
def test_a_crash_leaves_the_version_before(spark, table, monkeypatch, step):
    table.publish(lambda _: spark.range(3))

    def crash(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        build = lambda _: spark.range(7)
        if step == "build":
            build = crash
        elif step == "write":
            m.setattr("pyspark.sql.readwriter.DataFrameWriter.parquet", crash)
        elif step == "digest":
            m.setattr(publish, "row_digest", crash)
        elif step == "put":
            m.setattr(table, "_put", crash)
        else:
            m.setattr(table, "_fs", type("Fs", (), {"__getattr__": lambda _, n, fs=table._fs: crash if n == "makeQualified" else getattr(fs, n)})())
        with pytest.raises(KeyboardInterrupt):
            table.publish(build)
    again = publish.Table(spark, table.root)
    assert ids(again.read()) == [0, 1, 2] and again.numbers() == [0]
    assert again.publish(lambda _: spark.range(7)) == 1 and ids(again.read()) == list(range(7))
    again.vacuumed()
    assert ids(again.read(0)) == [0, 1, 2] and ids(again.read()) == list(range(7))


def test_two_writers(spark, table):
    table.publish(lambda _: spark.range(1))
    other, seen = publish.Table(spark, table.root), []

    def slow(now):
        seen.append(now.count())
        if len(seen) == 1:  # meanwhile, the other writer publishes
            other.publish(lambda rows: rows.union(spark.range(100, 101)))
        return now.union(spark.range(200, 201))

    assert table.publish(slow) == 2 and seen == [1, 2]
    assert ids(table.read()) == [0, 100, 200]  # neither undid the other

    def always(now):
        other.publish(lambda rows: rows.union(spark.range(now.count(), now.count() + 1)))
        return now.union(spark.range(900, 901))

    with pytest.raises(publish.Conflict):
        table.publish(always)
    assert 900 not in ids(table.read())


def test_snapshots_keep_what_is_as_it_was(spark, table):
    schema = "appl_no string, product string"
    publish.snapshot(table, spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c"), (None, "n")], schema), "appl_no", "2024-01-01T00:00:00", {"id": 1})
    version = publish.snapshot(table, spark.createDataFrame([("1", "b"), ("1", "a"), ("2", "d"), ("3", "e"), (None, "n")], schema), "appl_no", "2024-02-01T00:00:00", {"id": 2})
    got = sorted((str(r.appl_no), r["product"], r.refreshed_at[:7]) for r in table.read().collect())
    assert version == 1 and got == [("1", "a", "2024-01"), ("1", "b", "2024-01"), ("2", "d", "2024-02"), ("3", "e", "2024-02"), ("None", "n", "2024-01")]
    assert table.pointer()["freshness"] == "2024-02-01T00:00:00"
    assert publish.snapshot(table, spark.createDataFrame([("2", "d")], schema), "appl_no", "2024-03-01T00:00:00") == 1  # nothing new


def test_artifacts_are_written_once(spark, table):
    first = spark.createDataFrame([(b"one",), (b"two",), (b"one",), (None,), (b"",)], "content binary")
    assert publish.put_artifacts(table, first) == 0
    assert publish.put_artifacts(table, first) == 0
    assert publish.put_artifacts(table, spark.createDataFrame([(b"two",), (b"three",)], "content binary")) == 1
    rows = table.read().select("sha256", "bytes", (F.sha2("content", 256) == F.col("sha256")).alias("ok")).collect()
    assert sorted(r.bytes for r in rows) == [0, 3, 3, 5] and all(r.ok for r in rows) and len({r.sha256 for r in rows}) == 4
    pointer = table.pointer()
    assert pointer["rows"] == 4 and len(pointer["paths"]) == 2
    assert pointer["digest"] == table.read().agg(publish.row_digest(["sha256", "bytes", "content"])).first()[0]
