"""Keyed state in streams: several batches, late and unordered rows, a restart, against the batch twins."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.streaming import queries as streams

START = dt.datetime(2024, 1, 1)


def landed(spark, path, rows):
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    df.coalesce(1).write.mode("append").parquet(path)
    return df


def run(spark, path, checkpoint, out, **options):
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long").option("maxFilesPerTrigger", 1).parquet(path)
    limited = streams.rate_limited(stream, "user_id", 2, 60.0, **options)
    limited.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def at(i, seconds, user):
    return (i, START + dt.timedelta(seconds=seconds), user)


def test_unordered_rows_are_decided_in_order(spark, tmp_path):
    r = random.Random(21)
    source, checkpoint, out = (str(tmp_path / n) for n in ("in", "cp", "out"))
    rows = [at(i, i * 7, r.choice([1, 2, 3, None])) for i in range(120)]
    arriving = sorted(rows, key=lambda x: (x[1] + dt.timedelta(seconds=r.randrange(100)), x[0]))  # up to 100 s out of order
    for k in range(2):
        landed(spark, source, arriving[40 * k : 40 * k + 40])
    run(spark, source, checkpoint, out, late="2 minutes", wait=True)
    landed(spark, source, arriving[80:])
    run(spark, source, checkpoint, out, late="2 minutes", wait=True)  # goes on from the checkpoint
    landed(spark, source, [at(9000, 10**6, 1)])  # moves the watermark past all
    landed(spark, source, [at(9001, 2 * 10**6, 2)])
    got = run(spark, source, checkpoint, out, late="2 minutes", wait=True).filter("event_id < 9000")
    want = streams.rate_limited(spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long"), "user_id", 2, 60.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    source, checkpoint, out = (str(tmp_path / n) for n in ("in", "cp", "out"))
    for rows in ([at(1, 0, 1), at(2, 1000, 1)], [at(3, 1001, 1)], [at(4, 10, 1), at(5, 1002, 1), at(6, 1003, 1)], [at(7, 5000, 2)]):
        landed(spark, source, rows)
    got = {x.event_id: x.allowed for x in run(spark, source, checkpoint, out, late="1 minute").collect()}
    assert got == {1: True, 2: True, 3: True, 5: False, 6: False, 7: True}


def test_replayed_rows_pass_once(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    schema = "event_id long, ts timestamp, user_id long"

    def passed(name):
        stream = streams.deduplicated(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), ["event_id"], "1 hour")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(x.event_id for x in spark.read.parquet(str(tmp_path / "out")).collect())

    rows = [at(i, i * 60, i % 3) for i in range(30)]
    landed(spark, source, rows[:20])
    landed(spark, source, rows[10:25])
    assert passed("a") == list(range(25))
    landed(spark, source, rows[15:])
    assert passed("b") == list(range(30))
    twin = streams.deduplicated(spark.createDataFrame(rows + rows[5:], schema), ["event_id"])
    assert twin.select(F.count("*"), F.count_distinct("event_id")).first() == (30, 30)
