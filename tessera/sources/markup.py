"""HTML and XML sources: listing tables, visible text, coded sections. Parsers of the standard library, one document at a time."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import canonical_name, stripped_name
from ..functions.numbers import iso_date
from ..functions.sequential import udfs
from ..operators.sets import first_seen


class _Rows(HTMLParser):
    """Table rows: class, and per cell its text, links (href, title, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.cell = self.link = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "tr":
            self.rows.append({"class": (a.get("class") or "").split(), "cells": []})
            self.cell = None
        elif tag in ("td", "th") and self.rows:
            self.cell = {"text": "", "links": [], "head": tag == "th"}
            self.rows[-1]["cells"].append(self.cell)
        elif tag == "a" and self.cell is not None:
            self.link = {"href": a.get("href") or "", "title": a.get("title") or "", "text": ""}
            self.cell["links"].append(self.link)

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = None
        elif tag in ("td", "th", "tr", "table"):
            self.cell = self.link = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"] += data
        if self.link is not None:
            self.link["text"] += data


def table_rows(html: str) -> list[dict]:
    p = _Rows()
    p.feed(html or "")
    p.close()
    return p.rows


LISTING = "number int, appl_no string, active_ingredient string, psg_type string, route string, dosage_form string, numbers array<string>, date string"


def _listings(html: str) -> list[dict]:
    out = []
    for row in table_rows(html):
        cells = row["cells"]
        link = next((x for x in cells[0]["links"] if "PSG_" in x["href"]), None) if len(cells) >= 7 and "drugData" in row["class"] else None
        key = re.search(r"PSG_(\d+)\.pdf", link["href"]) if link else None
        if not key:
            continue
        text = [" ".join(c["text"].split()) for c in cells]
        numbers = re.findall(r"\d{5,6}", " ".join(x["text"] for x in cells[5]["links"]) or text[5])
        out.append({"number": len(out), "appl_no": key[1], "active_ingredient": (link["title"] or link["text"]).strip(), "psg_type": "draft" if "draft" in text[2].lower() else "final", "route": text[3] or None, "dosage_form": text[4] or None, "numbers": [n.zfill(6) for n in numbers], "date": text[6]})
    return out


def listings(pages: DataFrame) -> DataFrame:
    """pages: page_id, html. Listing rows, of equal number, route, form and type the first; a page without the table's markup is an
    error, since an empty listing would retire every document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"page_id": i, **r} for i, h in zip(f["page_id"], f["html"]) for r in _listings(h)]
            yield pd.DataFrame(rows, columns=["page_id", *(c.split()[0] for c in LISTING.split(", "))])

    marked = F.when(F.coalesce(F.contains("html", F.lit("drugData")), F.lit(False)), F.col("html")).otherwise(F.raise_error(F.lit("the page has no listing table")))
    rows = pages.select("page_id", marked.alias("html")).mapInPandas(run, f"page_id long, {LISTING}")
    rows = first_seen(rows.withColumn("_o", F.struct("page_id", "number")), ["appl_no", "route", "dosage_form", "psg_type"], "_o").drop("_o")
    url = F.concat(F.lit("https://www.accessdata.fda.gov/drugsatfda_docs/psg/PSG_"), "appl_no", F.lit(".pdf"))
    return rows.select("page_id", "appl_no", "active_ingredient", canonical_name(F.col("active_ingredient")).alias("normalized_name"), stripped_name(F.col("active_ingredient")).alias("stripped_name"), "psg_type", "route", "dosage_form", F.col("numbers").alias("rld_or_rs_numbers"), iso_date(F.col("date")).alias("recommended_date"), url.alias("pdf_url"))


def has_markup(pages: DataFrame, mark: str = "<tr") -> DataFrame:
    """pages, or an error when read if one answered without table markup."""
    return pages.filter(F.when(F.contains(F.lower("html"), F.lit(mark)), True).otherwise(F.raise_error(F.concat(F.lit("no table in page "), F.col("page_id").cast("string"))).cast("boolean")))


def visible(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.withColumn("visible_text", udfs()["visible_text"](html))


def plain_tables(pages: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of every table with as many cells as columns (headers left out): the retired programme lists."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, h in zip(f["page_id"], f["html"]):
                rows = [[" ".join(c["text"].split()) for c in r["cells"]] for r in table_rows(h) if len(r["cells"]) >= len(columns) and not any(c["head"] for c in r["cells"])]
                out += [{"page_id": i, "number": n, **dict(zip(columns, r))} for n, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["page_id", "number", *columns])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, number int, " + ", ".join(f"`{c}` string" for c in columns))


_NS = "{urn:hl7-org:v3}"


def coded_sections(xml: str, codes: list[str] | None = None) -> list[dict]:
    """code, title, text of coded sections in document order, the first of each code; a DTD or entity is refused."""
    if re.search(r"(?i)<!DOCTYPE|<!ENTITY", xml):
        raise ValueError("a document type definition isn't allowed")
    out: dict[str, dict] = {}
    for s in ET.fromstring(xml).iter(f"{_NS}section"):
        code = s.find(f"{_NS}code")
        c = " ".join((code.get("code") or "").split()) if code is not None else ""
        if not c or c in out or (codes is not None and c not in codes):
            continue
        title = s.find(f"{_NS}title")
        body = " ".join(" ".join("".join(x.itertext()) for x in s if x.tag not in (f"{_NS}title", f"{_NS}code")).split())
        out[c] = {"code": c, "title": " ".join("".join(title.itertext()).split()) or None if title is not None else None, "text": body}
    return list(out.values())


def sections(documents: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """documents: doc_id, xml -> doc_id, position, code, title, text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"doc_id": i, "position": n, **s} for i, x in zip(f["doc_id"], f["xml"]) if x for n, s in enumerate(coded_sections(x, codes))]
            yield pd.DataFrame(rows, columns=["doc_id", "position", "code", "title", "text"])

    return documents.select("doc_id", "xml").mapInPandas(run, "doc_id long, position int, code string, title string, text string")


def parsed(artifacts: DataFrame) -> DataFrame:
    """artifacts: mime, content (binary) -> with text: plain text as it is, HTML's visible text, null (for a PDF parser) otherwise."""
    kind = F.lower("mime")
    body = F.decode("content", "UTF-8")
    return artifacts.withColumn("text", F.when(kind.startswith("text/plain"), body).when(kind.startswith("text/html"), udfs()["visible_text"](F.when(kind.startswith("text/html"), body))))
