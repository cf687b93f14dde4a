"""spark.read.format("zip_member") and readStream: delimited members of ZIP archives as a Python data source.

Options: path (a folder of archives, or one archive; what pyarrow's file systems reach), member (an exact base name; the
one with the fewest folders, then the first by name, counts), sep (~), encoding (utf-8-sig), required (comma-joined
headers), and, as files in one batch of a stream, archives_per_batch. A partition is one archive; its member is read as a stream, without quoting. Columns: the headers of
the first archive, as strings with squeezed values, and archive and row (from 0). Headers that repeat, required ones that
are missing and archives without the member are errors; a header that an archive lacks is null there.

Filters on archive (=, IN, <, <=, >, >=) are pushed down: archives that fail them aren't opened. A stream takes archives in order of their
names, so a new archive's name must be above all before it."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .delimited import SourceError, pick_member

#: Rows of a batch.
ROWS = 10_000


@dataclass
class Archive(InputPartition):
    path: str
    name: str


class Members:
    """The archives under a path and their rows."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        for name in ("path", "member"):
            if name not in self.options:
                raise SourceError(f"zip_member needs the option {name}")
        self.path = self.options["path"]
        self.member, self.sep, self.encoding = self.options["member"], self.options.get("sep", "~"), self.options.get("encoding", "utf-8-sig")
        self.required = [c.strip() for c in self.options.get("required", "").split(",") if c.strip()]

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)

    def archives(self) -> list[Archive]:
        system, path = self._system()
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [Archive(path, info.base_name)]
        files = [f for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.base_name.lower().endswith(".zip")]
        return [Archive(f.path, f.base_name) for f in sorted(files, key=lambda f: f.base_name)]

    def lines(self, archive: Archive) -> Iterator[list[str]]:
        """The member's header and then its rows."""
        with self._system()[0].open_input_file(archive.path) as raw, zipfile.ZipFile(raw) as z:
            name = pick_member(z.namelist(), self.member)
            if name is None:
                raise SourceError(f"{archive.name} has no member {self.member}")
            with z.open(name) as body:
                rows = csv.reader(io.TextIOWrapper(body, encoding=self.encoding, newline=""), delimiter=self.sep, quoting=csv.QUOTE_NONE)
                header = [h.strip() for h in next(rows, [])]
                if len(set(header)) != len(header):
                    raise SourceError(f"{archive.name}: headers repeat")
                if lost := sorted(set(self.required) - set(header)):
                    raise SourceError(f"{archive.name}: missing columns {', '.join(lost)}")
                yield header
                yield from rows

    def schema(self) -> StructType:
        first = next(iter(self.archives()), None)
        if first is None:
            raise SourceError(f"no archives in {self.path}")
        return StructType([StructField("archive", StringType()), StructField("row", LongType()), *(StructField(h, StringType()) for h in next(self.lines(first)))])

    def batches(self, archive: Archive, schema: StructType) -> Iterator[pa.RecordBatch]:
        lines = self.lines(archive)
        place = {h: i for i, h in enumerate(next(lines))}
        number, arrow = 0, pa.schema([(f.name, pa.int64() if isinstance(f.dataType, LongType) else pa.string()) for f in schema])
        while part := list(islice(lines, ROWS)):
            cell = lambda row, i: " ".join(row[i].split()) if i is not None and i < len(row) else None
            columns = [[archive.name] * len(part) if c == "archive" else list(range(number, number + len(part))) if c == "row" else [cell(row, place.get(c)) for row in part] for c in schema.fieldNames()]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, arrow)], schema=arrow)
            number += len(part)


class ZipReader(DataSourceReader):
    COMPARED = {EqualTo: lambda a, b: a == b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, In: lambda a, b: a in b}

    def __init__(self, members: Members, schema: StructType):
        self.members, self.schema, self.kept = members, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in self.COMPARED and f.attribute == ("archive",):
                self.kept.append(f)
            else:
                yield f

    def partitions(self) -> list[Archive]:
        holds = lambda f, name: self.COMPARED[type(f)](name, getattr(f, "value", getattr(f, "values", None)))
        return [a for a in self.members.archives() if all(holds(f, a.name) for f in self.kept)]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        return self.members.batches(partition, self.schema)


class ZipStream(DataSourceStreamReader):
    """Offsets are the names of the last archives taken."""

    def __init__(self, members: Members, schema: StructType):
        self.members, self.schema = members, schema
        self.at = ""

    def initialOffset(self) -> dict[str, str]:
        return {"archive": ""}

    def latestOffset(self) -> dict[str, str]:
        names = [a.name for a in self.members.archives() if a.name > self.at]
        most = int(self.members.options.get("archives_per_batch", len(names) or 1))
        self.at = names[:most][-1] if names else self.at
        return {"archive": self.at}

    def partitions(self, start: dict[str, str], end: dict[str, str]) -> list[Archive]:
        self.at = max(self.at, end["archive"])  # after a restart, go on behind what the log has
        return [a for a in self.members.archives() if start["archive"] < a.name <= end["archive"]]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        return self.members.batches(partition, self.schema)

    def commit(self, end: dict[str, str]) -> None:
        pass


class ZipMember(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_member"

    def schema(self) -> StructType:
        return Members(self.options).schema()

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(Members(self.options), schema)

    def streamReader(self, schema: StructType) -> ZipStream:
        return ZipStream(Members(self.options), schema)


def register(spark: SparkSession) -> None:
    """Makes the source known, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipMember)
