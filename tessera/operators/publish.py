"""Published tables: readers always see one whole version, writers never undo each other, a repeated run adds nothing.

A version is a small pointer file, versions/<number>.json, that names folders of Parquet files, how many rows they have, their digest, how fresh
they are and the run that made them. Data is written first, to a folder of its own; then the pointer is put there, only if no
other writer took the number. Whoever loses builds again from the winner's version. Nothing is changed in place: a writer that dies leaves
at most a folder that no pointer names (vacuumed() removes it)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "number long, paths array<string>, rows long, digest string, freshness string, run string"


class Conflict(RuntimeError):
    """Other writers were faster, as often as was tried."""


class Table:
    """A published table under root, a folder that any Hadoop file system holds."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- readers ---

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def pointer(self, number: int | None = None) -> dict[str, Any] | None:
        """The pointer of a version, the latest by default; None where nothing was published."""
        numbers = [number] if number is not None else self.numbers()[-1:]
        if not numbers:
            return None
        stream = self._fs.open(self._path(f"{self.root}/versions/{numbers[0]:010}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, number: int | None = None) -> DataFrame | None:
        pointer = self.pointer(number)
        return self.spark.read.parquet(*pointer["paths"]) if pointer else None

    def runs(self) -> DataFrame:
        """A row for each version, with its run as JSON."""
        if not self.numbers():
            return self.spark.createDataFrame([], POINTER)
        return self.spark.read.schema(POINTER).json(f"{self.root}/versions/*.json")

    # --- writers ---

    def publish(self, build: Callable[[DataFrame | None], DataFrame], run: dict[str, Any] | None = None, freshness: str | None = None, append: bool = False, tries: int = 3) -> int:
        """Publishes build(current rows or None) and returns the version's number: with append as rows besides the current ones, else in
        their place. A result with the current version's digest, or nothing to append, makes no version. freshness names a column
        whose greatest value the pointer keeps."""
        for _ in range(tries):
            now = self.pointer()
            rows = build(self.read(now["number"]) if now else None)
            folder = f"{self.root}/data/{uuid.uuid4()}"
            rows.write.parquet(folder)
            made = self.spark.read.schema(rows.schema).parquet(folder)
            count, digest, fresh = made.agg(F.count("*"), row_digest(made.columns), F.max(F.col(freshness).cast("string")) if freshness else F.lit(None)).first()
            if now and (append and not count or not append and digest == now["digest"]):
                self._delete(folder)
                return now["number"]
            if append and now:
                before, total = now["paths"], now["rows"] + count
                digest, fresh = added_digests(now["digest"], digest), max(x for x in (now["freshness"], fresh, "") if x is not None) or None
            else:
                before, total = [], count
            number = now["number"] + 1 if now else 0
            pointer = {"number": number, "paths": [*before, folder], "rows": total, "digest": digest, "freshness": fresh, "run": json.dumps(run) if run is not None else None}
            if self._put(pointer):
                return number
            self._delete(folder)
        raise Conflict(f"{self.root}: {tries} tries")

    def _put(self, pointer: dict[str, Any]) -> bool:
        """Writes a pointer beside its place, then renames it unless the place is taken."""
        place = f"{self.root}/versions/{pointer['number']:010}.json"
        beside = f"{self.root}/versions/_{uuid.uuid4()}"
        out = self._fs.create(self._path(beside), False)
        try:
            out.write(bytearray(json.dumps(pointer, ensure_ascii=False).encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            files.rename(self._fs.makeQualified(self._path(beside)), self._fs.makeQualified(self._path(place)), none)
        except Exception as e:
            if not self._fs.exists(self._path(place)):
                raise e
            self._delete(beside)
            return False
        return True

    def _delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def vacuumed(self, keep: int = 2) -> list[str]:
        """Removes folders that none of the last keep versions names, and older pointers; call it while no writer works."""
        numbers = self.numbers()
        named = {p.rsplit("/", 1)[-1] for n in numbers[-keep:] for p in self.pointer(n)["paths"]}
        for n in numbers[:-keep]:
            self._delete(f"{self.root}/versions/{n:010}.json")
        data = self._path(f"{self.root}/data")
        gone = [s.getPath().getName() for s in self._fs.listStatus(data) if s.getPath().getName() not in named] if self._fs.exists(data) else []
        for name in gone:
            self._delete(f"{self.root}/data/{name}")
        return gone


def row_digest(columns: list[str]) -> Column:
    """An order-free digest of rows: the exact sum of 60-bit pieces of their hashes, and their number."""
    body = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    piece = F.conv(F.substring(F.sha2(body, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.concat_ws("-", F.count("*").cast("string"), F.coalesce(F.sum(piece), F.lit(0).cast("decimal(38,0)")).cast("string"))


def added_digests(a: str, b: str) -> str:
    """The digest of two tables' rows together."""
    return "-".join(str(int(x) + int(y)) for x, y in zip(a.split("-"), b.split("-")))


def replaced(current: DataFrame | None, rows: DataFrame, *keys: str) -> DataFrame:
    """current with all rows of the keys that rows have replaced by those."""
    if current is None:
        return rows
    same = rows.select(*(F.col(k).alias(f"_{k}_") for k in keys)).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys]
    return current.join(same, on, "left_anti").unionByName(rows)


def snapshot(table: Table, rows: DataFrame, key: str, observed: str, run: dict[str, Any] | None = None) -> int:
    """Publishes a snapshot: the rows of its applications (key) replace theirs, with observed (an ISO time) as refreshed_at. Applications that
    are as they were keep their rows and their time."""
    fields = [c for c in rows.columns if c != key]

    def build(current: DataFrame | None) -> DataFrame:
        new = rows.withColumn("refreshed_at", F.lit(observed))
        if current is None:
            return new
        digest = lambda df: df.groupBy(key).agg(row_digest([key, *fields]).alias("_d"))
        same = digest(rows).join(digest(current).withColumnsRenamed({key: "_k", "_d": "_e"}), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_d") == F.col("_e"))).select(F.col(key).alias("_k"))
        return replaced(current, new.join(same, F.col(key).eqNullSafe(F.col("_k")), "left_anti"), key)

    return table.publish(build, run, freshness="refreshed_at")


def put_artifacts(table: Table, artifacts: DataFrame, run: dict[str, Any] | None = None) -> int:
    """artifacts: content (binary). Stores what the table doesn't have yet under its SHA-256 (sha256, bytes, content): content that is there is
    never written again."""

    def build(current: DataFrame | None) -> DataFrame:
        new = artifacts.filter("content is not null").select(F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"), "content").dropDuplicates(["sha256"])
        return new if current is None else new.join(current.select("sha256"), "sha256", "left_anti")

    return table.publish(build, run, append=True)

