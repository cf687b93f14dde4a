"""What the training-data operators share: reading tables, cutting lineage, bounded joins."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the word pattern of every operator here (Java and RE2 syntax alike).
WORD = r"[^\x20\x09-\x0D]+"

#: A table joined by broadcast has at most so many rows; beyond that the join is shuffled.
BROADCAST_ROWS = 100_000
#: The same for tables of an id and at most another number and a flag: some 30 MB.
NARROW_ROWS = 500_000
#: Rows of whole texts that Spark hands to a Python worker at once, where an operator runs its jobs itself.
TEXT_ROWS = 1_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where none is set, a temporary one in local mode, and an error on a cluster,
    whose machines don't share one."""
    have = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if have is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        have = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.sparkContext.setCheckpointDir(have)
    return have


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there: lost executors don't matter."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings while jobs run or a stream starts, which keeps its own copy."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Batches of TEXT_ROWS rows at most, or of the session's fewer, for the jobs that run meanwhile."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    return settings(spark, {key: str(min(now, TEXT_ROWS) if now > 0 else TEXT_ROWS)})


def lookup(rows: DataFrame, small: DataFrame, on: list[str], small_rows: int, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined with a table of known size: broadcast up to most rows, shuffled beyond (AQE splits hot keys)."""
    return rows.join(F.broadcast(small) if small_rows <= most else small, on, how)


def shielded(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but own under names that no operator uses, and the function that names a result's columns again."""
    names = {c: c if c in own else f"_shielded_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), lambda out: out.select(*(F.col(b).alias(a) for a, b in names.items()))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a scan's size: file sizes, without a job."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(stats.sizeInBytes().toString())
