"""Delimited snapshots, plain or inside ZIP archives, read through Spark so that any Hadoop path works."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import squeeze

#: Fields of the product, patent and exclusivity members, with their headers.
PRODUCTS = {
    "ingredient": "Ingredient", "dosage_form_route": "DF;Route", "trade_name": "Trade_Name", "applicant": "Applicant", "strength": "Strength",
    "appl_type": "Appl_Type", "appl_no": "Appl_No", "product_no": "Product_No", "te_code": "TE_Code", "approval_date": "Approval_Date",
    "rld": "RLD", "rs": "RS", "type": "Type", "applicant_full_name": "Applicant_Full_Name",
}
PATENTS = {
    "appl_type": "Appl_Type", "appl_no": "Appl_No", "product_no": "Product_No", "patent_no": "Patent_No", "patent_expire_date": "Patent_Expire_Date_Text",
    "drug_substance_flag": "Drug_Substance_Flag", "drug_product_flag": "Drug_Product_Flag", "patent_use_code": "Patent_Use_Code",
    "delist_flag": "Delist_Flag", "submission_date": "Submission_Date",
}
EXCLUSIVITIES = {"appl_type": "Appl_Type", "appl_no": "Appl_No", "product_no": "Product_No", "exclusivity_code": "Exclusivity_Code", "exclusivity_date": "Exclusivity_Date"}


class SourceError(ValueError):
    pass


def tilde(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """A tilde-delimited file with a header, without quoting: the columns by their field names, squeezed; missing ones are null."""
    raw = spark.read.options(sep="~", header=True, quote="", encoding="UTF-8", mode="PERMISSIVE").csv(path)
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    return raw.select(*(squeeze(F.col(f"`{names[h]}`")).alias(f) if h in names else F.lit(None).cast("string").alias(f) for f, h in columns.items()))


#: The bytes in which Windows-1252 differs from Latin-1 (Spark reads only the latter), and their characters.
_WINDOWS = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_AS_LATIN, _AS_WINDOWS = "".join(map(chr, _WINDOWS)), bytes(_WINDOWS).decode("cp1252")


def tab_separated(spark: SparkSession, path: str, required: set[str]) -> DataFrame:
    """A TSV table in Windows-1252: required columns must be there and headers distinct; values squeezed, ApplNo padded to six
    digits."""
    options = {"sep": "\t", "quote": "", "encoding": "iso-8859-1"}
    head = spark.read.options(**options, header=False).csv(path).first()
    if head is None:
        raise SourceError("the table is empty")
    headers = [(h or "").lstrip("\ufeff").removeprefix("\xef\xbb\xbf").strip() for h in head]
    _check_headers(headers, required)
    table = spark.read.options(**options, header=True).csv(path).toDF(*headers)
    return _padded(table.select(*(squeeze(F.translate(F.col(f"`{c}`"), _AS_LATIN, _AS_WINDOWS)).alias(c) for c in headers)))


def table_set(spark: SparkSession, folder: str, required: dict[str, set[str]], suffix: str = ".txt") -> dict[str, DataFrame]:
    """All tables of a snapshot (name -> required columns); one that is missing is an error before any is read."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if lost := [n for n in required if not fs.exists(hadoop(f"{folder}/{n}{suffix}"))]:
        raise SourceError(f"missing tables: {', '.join(sorted(lost))}")
    return {n: tab_separated(spark, f"{folder}/{n}{suffix}", columns) for n, columns in required.items()}


def _check_headers(headers: list[str], required: set[str]) -> None:
    if len(set(headers)) != len(headers):
        raise SourceError("headers repeat")
    if lost := sorted(required - set(headers)):
        raise SourceError(f"missing columns: {', '.join(lost)}")


def _padded(table: DataFrame) -> DataFrame:
    if "ApplNo" not in table.columns:
        return table
    return table.withColumn("ApplNo", F.when((F.col("ApplNo") != "") & (F.length("ApplNo") < 6), F.lpad("ApplNo", 6, "0")).otherwise(F.col("ApplNo")))


def pick_member(names: list[str], wanted: str) -> str | None:
    """The member of exactly that base name with the fewest folders, then the first by name; None if there is none."""
    return min((n for n in names if n.rsplit("/", 1)[-1] == wanted), key=lambda n: (n.count("/"), n), default=None)


def zip_rows(spark: SparkSession, path: str, member: str, sep: str, encoding: str = "utf-8-sig", most_bytes: int = 256 << 20) -> DataFrame:
    """archive, number, fields (map of header to value) of a member of every archive under path. A missing member is an error,
    never an empty table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    name = pick_member(z.namelist(), member)
                    if name is None:
                        raise SourceError(f"{archive} has no member {member}")
                    if z.getinfo(name).file_size > most_bytes:
                        raise SourceError(f"{member} is too large")
                    rows = csv.DictReader(io.StringIO(z.read(name).decode(encoding)), delimiter=sep, quoting=csv.QUOTE_NONE)
                    out = [{k: " ".join((v or "").split()) for k, v in r.items() if k is not None} for r in rows]
                yield pd.DataFrame({"archive": archive, "number": range(len(out)), "fields": out})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, number long, fields map<string,string>")


def member(spark: SparkSession, path: str, name: str, columns: Mapping[str, str], sep: str = "~") -> DataFrame:
    return zip_rows(spark, path, name, sep).select(*(F.col("fields")[h].alias(f) for f, h in columns.items()))
