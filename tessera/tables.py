"""Reading tables, joins whose broadcast is checked, and cutting lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of known size is broadcast.
BROADCAST_ROWS = 100_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its known number of rows allows it; otherwise Catalyst shuffles the join."""
    return F.broadcast(df) if rows <= limit else df


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there: what iterates keeps a short lineage, lost executors don't
    matter. A cluster must name the folder in spark.checkpoint.dir; local mode has one of its own otherwise."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
