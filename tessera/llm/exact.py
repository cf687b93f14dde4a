"""Exact deduplication by a stateful stream whose keyed state is on disk and never expires.

A streaming aggregation reads files as they arrive. Per digest of the normalised text its RocksDB state keeps how many rows
had it, the greatest id (the row that stays), and that row's locator: file and place in the file. Rows of one digest are
counted before they are shuffled, so a hot text is one row a task. A later call goes on from the state of the one before.

Decisions join rows with the state (read back as a table). Every hit is then checked byte by byte: the text at the locator
meets each other row of its digest, dealt out so that one text of many copies is many small joins. Digests under which
different texts are found are grouped again by the whole text.

Defined results: a null text is the empty text, and both are copies of each other; only A-Z are lower-cased; a null id is
below every id; of rows with equal text and id, the last by file and place stays; rows of one id are judged each; an
empty table gives an empty result; other columns are ignored; texts may have any length.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, ensure_checkpoint_dir, read, settings

#: State settings of the stream: on disk, with a bound on RocksDB's memory per executor, and closed between batches, so that
#: an executor has open what its running tasks use, however many partitions the state has.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Groups of more than this share of all rows are joined by broadcast (so they are fewer than its inverse), the others by a shuffle.
HOT_SHARE = 1 / 10_000
#: Copies that meet one copy of the text that they are compared with.
COPIES = 1000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def fingerprints(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """docs, read from files: doc_id, norm, digest, at (locator)."""
    text = F.coalesce("text", F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    norm = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"), at.alias("at")).withColumn("digest", digest(F.col("norm")))


def ingest(spark: SparkSession, path: str, home: str, digest: Callable[[Column], Column] = sha256, options: dict[str, str] | None = None) -> None:
    """Takes what is new in the Parquet file, or folder of files, at path into the state under home. options: of the file
    source, such as maxBytesPerTrigger, so that a large backlog is taken in several batches."""
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    # as a pattern that only path matches: a single file may then be streamed too
    new = spark.readStream.schema(schema).options(**options or {}).parquet(f"{path[:-1]}[{path[-1]}]")
    state = fingerprints(new, digest).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "at")).alias("keep"))
    with settings(spark, STATE):
        stream = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", home).trigger(availableNow=True).start()
    stream.awaitTermination()


def known(spark: SparkSession, home: str) -> DataFrame:
    """The state: digest, n, keep (doc_id, at)."""
    state = spark.read.format("statestore").load(home)
    key, (n, keep) = state.schema["key"].dataType.names[0], state.schema["value"].dataType.names
    return state.select(F.col("key")[key].alias("digest"), F.col("value")[n].alias("n"), F.col("value")[keep].alias("keep"))


def with_groups(rows: DataFrame, groups: DataFrame, n_groups: int, n_rows: int) -> DataFrame:
    """rows with n and keep of their digest's group, null without one. Groups with the most rows are broadcast; their rows take
    no part in the shuffle by digest that follows where groups are many."""
    if n_groups <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), "digest", "left")
    hot = groups.filter(F.col("n") > n_rows * HOT_SHARE).withColumnsRenamed({"n": "hot_n", "keep": "hot_keep"})
    cold = groups.filter(F.col("n") <= n_rows * HOT_SHARE).withColumnRenamed("digest", "key")
    own = F.encode(F.concat(F.lit("row "), F.xxhash64("at").cast("string")), "UTF-8")  # no digest: meets no group
    marked = rows.join(F.broadcast(hot), "digest", "left").withColumn("key", F.when(F.col("hot_n").isNull(), F.col("digest")).otherwise(own))
    found = marked.join(cold, "key", "left")
    return found.withColumns({"n": F.coalesce("n", "hot_n"), "keep": F.coalesce("keep", "hot_keep")}).drop("key", "hot_n", "hot_keep")


def unlike(found: DataFrame) -> DataFrame:
    """Digests with a row whose bytes aren't those at the locator of its group."""
    parts = F.ceil(F.col("n") / COPIES)
    hits = found.filter("n > 1").select("digest", "norm", "at", "keep", parts.cast("long").alias("parts"))
    kept = F.col("at") == F.col("keep.at")
    texts = hits.filter(kept).select("digest", F.col("norm").alias("kept_norm"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    copies = hits.filter(~kept).select("digest", "norm", F.pmod(F.xxhash64("at"), F.col("parts")).alias("part"))
    return copies.join(texts, ["digest", "part"], "left").filter(~F.col("norm").eqNullSafe(F.col("kept_norm"))).select("digest").distinct()


def decide(docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """docs, the files that state has taken in: doc_id, at, digest, keep_id, group_size, kept, one row for each of theirs."""
    groups = cut(state.filter("n > 1"))
    n_groups, in_groups = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = with_groups(fingerprints(docs, digest), groups, n_groups, in_groups)
    wrong = cut(unlike(found))
    n_wrong = wrong.count()

    def decided(rows: DataFrame) -> DataFrame:
        kept = F.coalesce(F.col("at") == F.col("keep.at"), F.lit(True))
        keep_id = F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id"))
        return rows.select("doc_id", "at", "digest", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"))

    if not n_wrong:
        return decided(found)
    wrong = F.broadcast(wrong) if n_wrong <= BROADCAST_ROWS else wrong
    clashing = found.join(wrong, "digest", "left_semi").drop("n", "keep")
    exact = clashing.groupBy("digest", "norm").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "at")).alias("keep"))
    return decided(found.join(wrong, "digest", "left_anti")).unionByName(decided(clashing.join(exact, ["digest", "norm"])))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, home = f"{sf_dir}/documents.parquet", f"{ensure_checkpoint_dir(spark)}/exact-{uuid.uuid4()}"
    ingest(spark, path, home)
    out = decide(read(spark, sf_dir, "documents"), known(spark, home))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP11_SQL = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
