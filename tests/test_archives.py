"""The ZIP member source: reads, pushed filters, errors, and streams with restarts."""

from __future__ import annotations

import zipfile

import pytest

from tessera.sources import archives

HEADER = "Ingredient~DF;Route~Trade_Name"


def archive(folder, name, rows, member="in/products.txt", header=HEADER, more=()):
    with zipfile.ZipFile(f"{folder}/{name}", "w") as z:
        for other in more:
            z.writestr(other, "x")
        z.writestr(member, "﻿" + "\r\n".join([header, *rows]))


@pytest.fixture
def folder(spark, tmp_path):
    archives.register(spark)
    archive(tmp_path, "2024-01.zip", ['A "quoted"~TABLET;ORAL~One', "B   b~~Two", "C~CAPSULE"], more=("z/products.txt2", "deep/er/products.txt"))
    archive(tmp_path, "2024-02.zip", ["D~x~Three"], header="Trade_Name~Ingredient~Other")
    archive(tmp_path, "2024-03.zip", [f"E{i}~y~z" for i in range(25_000)])
    (tmp_path / "notes.txt").write_text("no archive")
    return str(tmp_path)


def read(spark, folder, **options):
    return spark.read.format("zip_member").options(path=folder, member="products.txt", **options).load()


def test_rows(spark, folder):
    df = read(spark, folder)
    assert df.columns == ["archive", "row", "Ingredient", "DF;Route", "Trade_Name"] and df.rdd.getNumPartitions() == 3
    first = sorted(tuple(r) for r in df.filter("archive = '2024-01.zip'").collect())
    assert first == [("2024-01.zip", 0, 'A "quoted"', "TABLET;ORAL", "One"), ("2024-01.zip", 1, "B b", "", "Two"), ("2024-01.zip", 2, "C", "CAPSULE", None)]
    # columns go by header; what an archive lacks is null
    assert [tuple(r) for r in df.filter("archive = '2024-02.zip'").collect()] == [("2024-02.zip", 0, "x", None, "D")]
    assert df.filter("archive >= '2024-03' and row >= 24990").count() == 10


def test_filters_are_pushed(spark, folder, tmp_path):
    (tmp_path / "2024-09.zip").write_bytes(b"broken: must not be opened")
    df = read(spark, folder).filter("archive in ('2024-01.zip', '2024-02.zip') and Ingredient <> 'x'")
    assert df.count() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "2024-01.zip" not in plan  # what stays above the scan is the other column's filter
    with pytest.raises(Exception):
        read(spark, folder).filter("row = 0").count()


def test_errors(spark, folder, tmp_path):
    with pytest.raises(Exception, match="has no member"):
        spark.read.format("zip_member").options(path=folder, member="nothing.txt").load().count()
    with pytest.raises(Exception, match="missing columns Gone"):
        read(spark, folder, required="Ingredient, Gone").count()
    with pytest.raises(Exception, match="needs the option member"):
        spark.read.format("zip_member").options(path=folder).load().count()
    archive(tmp_path, "2024-00.zip", ["a~b"], header="H~H")
    with pytest.raises(Exception, match="headers repeat"):
        read(spark, folder).count()


def test_stream_and_restart(spark, folder, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run(**options):
        stream = spark.readStream.format("zip_member").options(path=folder, member="products.txt", **options).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        return {r["archive"]: r["count"] for r in spark.read.parquet(out).groupBy("archive").count().collect()}, query

    first, query = run(archives_per_batch="1")
    assert first == {"2024-01.zip": 3, "2024-02.zip": 1, "2024-03.zip": 25_000}
    assert sum(p.numInputRows > 0 for p in query.recentProgress) == 3
    archive(folder, "2024-04.zip", ["F~a~b", "G~a~b"])
    assert run()[0] == first | {"2024-04.zip": 2}  # goes on from the checkpoint: nothing twice
