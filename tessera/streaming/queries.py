"""Structured Streaming over the event log: windows, sessions, exact rate limits, idempotent micro-batches.

Every stream has a batch twin of the same definition in operators/, which serves as its oracle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ListState, StatefulProcessor, StatefulProcessorHandle

from ..operators.merge import inserted


def stamped(events: DataFrame, stamp: str = "ts") -> DataFrame:
    """Zone-less stamps as UTC timestamps: watermarks need them. The session must be in UTC."""
    return events.withColumn(stamp, F.col(stamp).cast("timestamp"))


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "1 hour", *keys: str, stamp: str = "ts") -> DataFrame:
    """Counts per window and keys; on a stream with a watermark, on a table without effect."""
    rows = stamped(events, stamp)
    rows = rows.withWatermark(stamp, late) if rows.isStreaming else rows
    n = rows.groupBy(F.window(stamp, length).alias("w"), *keys).agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def sliding(events: DataFrame, length: str, slide: str, late: str, *keys: str, stamp: str = "ts") -> DataFrame:
    rows = stamped(events, stamp)
    rows = rows.withWatermark(stamp, late) if rows.isStreaming else rows
    n = rows.groupBy(F.window(stamp, length, slide).alias("w"), *keys).agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour", stamp: str = "ts") -> DataFrame:
    rows = stamped(events, stamp)
    rows = rows.withWatermark(stamp, late) if rows.isStreaming else rows
    n = rows.groupBy(F.session_window(stamp, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return n.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def allowed_calls(times: list[int], recent: list[int], limit: int, window: int) -> tuple[list[bool], list[int]]:
    """Which calls a limiter admits: fewer than limit admitted ones in the window before; denied calls aren't recorded; a limit
    of 0 or less admits all."""
    out = []
    for t in times:
        recent = [r for r in recent if t - r < window]
        ok = limit <= 0 or len(recent) < limit
        if ok:
            recent.append(t)
        out.append(ok)
    return out, recent


LIMITED = "event_id long, allowed boolean"


def _micros(stamps: pd.Series) -> list[int]:
    return stamps.astype("datetime64[us]").astype("int64").tolist()


class Limiter(StatefulProcessor):
    """Admitted times of a key as list state, and, where decisions wait for the watermark, the calls that it hasn't passed.

    A timer drops what no later call can depend on; expired keys leave nothing behind."""

    def __init__(self, limit: int, seconds: float, wait: bool):
        self.limit, self.window, self.wait = limit, round(seconds * 1_000_000), wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "t long")
        self.pending = handle.getListState("pending", "t long, id long")

    def _decided(self, calls: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        calls.sort()
        recent = [t for (t,) in self.recent.get()]
        ok, recent = allowed_calls([t for t, _ in calls], recent, self.limit, self.window)
        self._keep(self.recent, [(t,) for t in recent])
        yield pd.DataFrame({"event_id": [i for _, i in calls], "allowed": ok})

    def _keep(self, state: ListState, rows: list[tuple]) -> None:
        state.put(rows) if rows else state.clear()

    def _wake(self, micros: int, watermark: int) -> None:
        self.handle.registerTimer(max(micros // 1000, watermark) + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, calls = timerValues.getCurrentWatermarkInMs(), []
        for pdf in rows:
            calls += zip(_micros(pdf["call_at"]), pdf["call_id"].tolist())
        if self.wait:
            self.pending.appendList(calls)
            self._wake(min(calls)[0], watermark)
            return
        self._wake(max(calls)[0] + self.window, watermark)
        yield from self._decided(calls)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.wait:
            calls = [tuple(r) for r in self.pending.get()]
            due, later = [c for c in calls if c[0] < watermark * 1000], [c for c in calls if c[0] >= watermark * 1000]
            self._keep(self.pending, later)
            if later:
                self._wake(min(later)[0], watermark)
            if due:
                self._wake(max(due)[0] + self.window, watermark)
                yield from self._decided(due)
                return
        self._keep(self.recent, [(t,) for (t,) in self.recent.get() if t + self.window > watermark * 1000])


def rate_limited(events: DataFrame, key: str, limit: int, seconds: float = 60.0, stamp: str = "ts", id_: str = "event_id", late: str = "1 hour", wait: bool = False) -> DataFrame:
    """event_id, allowed: an exact limiter. On a table the admitted times are carried through the key's rows in order of stamp, then id.

    On a stream they are state per key (RocksDB state store). A call is decided when it arrives, among the calls that came
    before; with wait, when the watermark (late behind) has passed it: then rows that came out of order are decided in
    order, as on a table, and rows later than the watermark are left out."""
    rows = stamped(events, stamp)
    if not events.isStreaming:

        def once(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([stamp, id_])
            ok, _ = allowed_calls(_micros(pdf[stamp]), [], limit, round(seconds * 1_000_000))
            return pd.DataFrame({"event_id": pdf[id_], "allowed": ok})

        return rows.select(key, stamp, id_).groupBy(key).applyInPandas(once, LIMITED)
    rows = rows.select(F.col(key), F.col(stamp).alias("call_at"), F.col(id_).alias("call_id")).withWatermark("call_at", late)
    return rows.groupBy(key).transformWithStateInPandas(Limiter(limit, seconds, wait), LIMITED, "append", "EventTime")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour", stamp: str = "ts") -> DataFrame:
    rows = stamped(events, stamp)
    return rows.withWatermark(stamp, late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def sync(spark: SparkSession, source: str, schema: str, target: str, keys: list[str], checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """Everything new under source, once: each micro-batch lands the rows whose keys target lacks, so a replay adds nothing."""

    def land(batch: DataFrame, _: int) -> None:
        rows = transform(batch)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(target)
        have = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        new = inserted(spark.read.schema(rows.schema).parquet(target), rows, keys) if have else rows.dropDuplicates(keys)
        new.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(land)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def finished(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and gives its result table (in memory: for small results and tests)."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
