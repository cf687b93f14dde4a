"""Writes: upserts, insert-if-absent, replaced partitions. Plain Parquet folders; a new version is written beside the old one
and then swapped in, so that nothing is overwritten while it is read, and a failed write leaves the old version."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those of equal keys. new has one row per key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new that land: their keys aren't in old; of repeated keys one."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def merged(old: DataFrame, new: DataFrame, keys: list[str], update: dict[str, Column], when: Column | None = None) -> DataFrame:
    """Conditional upsert: matched rows take update (columns may be named o.x and n.x) where when holds, all else stays; unmatched
    rows of new are inserted."""
    o, n = old.select(F.struct(*old.columns).alias("o")), new.select(F.struct(*old.columns).alias("n"))
    on = reduce(lambda a, b: a & b, (F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys))
    j = o.join(n, on, "full_outer")
    ok = F.lit(True) if when is None else when
    return j.select(*(F.when(F.col("o").isNull(), F.col(f"n.{c}")).when(F.col("n").isNull() | ~ok, F.col(f"o.{c}")).otherwise(update.get(c, F.col(f"o.{c}"))).alias(c) for c in old.columns))


def without_other_versions(rows: DataFrame, document: str, value, version: str, keep) -> DataFrame:
    """Deletes all versions of a document but one, null versions too."""
    return rows.filter(~F.col(document).eqNullSafe(F.lit(value)) | F.col(version).eqNullSafe(F.lit(keep)))


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that rows have, and no others; safe to repeat."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def swap_in(rows: DataFrame, path: str) -> None:
    """Writes rows as path's new content: beside it first, then by renaming. A driver that dies between the two renames leaves
    the old version beside the path; recovered(), which this calls first, puts it back."""
    spark: SparkSession = rows.sparkSession
    recovered(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    new, old = f"{path}.new-{uuid.uuid4()}", f"{path}.old-{uuid.uuid4()}"
    rows.write.parquet(new)
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), hadoop(old))
    fs.rename(hadoop(new), hadoop(path))
    fs.delete(hadoop(old), True)


def recovered(spark: SparkSession, path: str) -> bool:
    """Whether path was missing and its old version, left beside it by an interrupted swap, was put back."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    home = hadoop(path)
    fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(home) or not fs.exists(home.getParent()):
        return False
    left = [s.getPath() for s in fs.listStatus(home.getParent()) if s.getPath().getName().startswith(f"{home.getName()}.old-")]
    return bool(left) and fs.rename(left[0], home)


def write_digest(rows: DataFrame, folder: str, day: str) -> str:
    """JSON lines of a day; written also when empty, since an empty digest says that nothing happened."""
    path = f"{folder}/day={day}"
    rows.write.mode("overwrite").json(path)
    return path


def write_manifest(rows: DataFrame, path: str, key: str = "canonical_id") -> str:
    """Gzipped JSON lines in order of key; returns the digest that read_manifest checks."""
    lines = rows.orderBy(key).select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("overwrite").option("compression", "gzip").text(path)
    return line_digest(lines)


def line_digest(lines: DataFrame) -> str:
    """An order-free digest of lines: the exact sum of 60-bit pieces of their hashes, and their number."""
    piece = F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    r = lines.agg(F.count("*").alias("n"), F.coalesce(F.sum(piece), F.lit(0).cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}-{int(r['s']):x}"


def read_manifest(spark: SparkSession, path: str, digest: str, schema: str) -> DataFrame:
    lines = spark.read.text(path)
    if line_digest(lines) != digest:
        raise ValueError("the manifest's content doesn't have its digest")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")
