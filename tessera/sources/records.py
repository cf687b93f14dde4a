"""JSON lines, manifests, registries, PDF artifacts, source routing and the policy on source addresses."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import union_all

#: Approved sources in routing order, those of an unspecific question, hosts and path prefixes by family.
SOURCES = ("drugs_at_fda", "action_package", "psg", "fda_be_guidance", "orange_book")
DEFAULT = ("drugs_at_fda", "orange_book", "psg", "fda_be_guidance")
HOSTS = ("fda.gov", "www.fda.gov", "accessdata.fda.gov", "www.accessdata.fda.gov")
PATHS = {
    "drugs_at_fda": ("/drugs/drug-approvals-and-databases/drugsfda-data-files", "/media/89850/download", "/scripts/cder/daf/", "/drugsatfda_docs/", "/downloads/drugs/", "/drugs/drugsafety/", "/drugs/drug-safety-and-availability/", "/drugs/postmarket-drug-safety-information-patients-and-providers/", "/drugs/emergencypreparedness/", "/newsevents/newsroom/pressannouncements/", "/cder/drug/"),
    "action_package": ("/scripts/cder/daf/", "/drugsatfda_docs/"),
    "psg": ("/drugs/guidances-drugs/product-specific-guidances-generic-drug-development", "/scripts/cder/psg/", "/drugsatfda_docs/psg/"),
    "fda_be_guidance": ("/regulatory-information/search-fda-guidance-documents/",),
    "orange_book": ("/drugs/drug-approvals-and-databases/orange-book-data-files", "/drugs/drug-approvals-and-databases/orange-book-", "/media/76860/download", "/scripts/cder/ob/", "/drugsatfda_docs/ob/"),
}

#: Paths that are allowed as they stand, but nothing below them.
EXACT = {"fda_be_guidance": ("/media/163638/download", "/media/165049/download", "/media/183189/download", "/media/186703/download", "/media/192774/download")}


def json_lines(spark: SparkSession, path: str, schema: str, required: Iterable[str] = ()) -> DataFrame:
    """JSON lines; blank lines and those that begin with # are skipped; a line without a required field is an error."""
    lines = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    rows = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    lost = [F.when(F.col(c).isNull(), F.lit(c)) for c in required]
    if not lost:
        return rows
    first = F.coalesce(*lost)
    return rows.filter(F.when(first.isNotNull(), F.raise_error(F.concat(F.lit("missing field "), first)).cast("boolean")).otherwise(F.lit(True)))


def manifest(spark: SparkSession, path: str, schema: str, version: int) -> DataFrame:
    """The artifacts of a JSON manifest of exactly this schema_version."""
    doc = spark.read.schema(f"schema_version int, artifacts array<struct<{schema}>>").json(path, multiLine=True)
    good = F.when(F.col("schema_version").eqNullSafe(F.lit(version)), F.col("artifacts")).otherwise(F.raise_error(F.lit("unsupported schema_version")))
    return doc.select(F.explode(good).alias("a")).select("a.*")


def registry(raw: DataFrame) -> DataFrame:
    """raw: key, payload (JSON of a structure registry) -> key, cid, smiles, inchikey, unii, status."""
    at = lambda path: F.get_json_object("payload", path)
    cid = at("$.IdentifierList.CID[0]")
    p = "$.PropertyTable.Properties[0]"
    syn = F.from_json(at("$.InformationList.Information[0].Synonym"), "array<string>")
    unii = F.try_element_at(F.filter(syn, lambda s: s.rlike("^UNII-[A-Z0-9]{10}$")), F.lit(1))
    out = raw.select("key", F.coalesce(cid, at(f"{p}.CID")).cast("long").alias("cid"), F.coalesce(at(f"{p}.SMILES"), at(f"{p}.CanonicalSMILES")).alias("smiles"), at(f"{p}.InChIKey").alias("inchikey"), F.regexp_replace(unii, "^UNII-", "").alias("unii"))
    return out.withColumn("status", F.when(F.col("smiles").isNotNull(), "resolved").when(F.col("cid").isNotNull(), "partial").otherwise("not_found"))


def pdf_pages(artifacts: DataFrame, most_pages: int = 3000) -> DataFrame:
    """artifacts: path, content -> path, page, text. A document of more pages is an error, never a part of it. Needs pypdf where it runs; without it this raises when executed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pypdf import PdfReader

        for f in frames:
            rows = []
            for p, c in zip(f["path"], f["content"]):
                pages = PdfReader(io.BytesIO(c)).pages
                if len(pages) > most_pages:
                    raise ValueError(f"{p}: PDF has {len(pages)} pages, exceeds {most_pages}")
                rows += [(p, n, x.extract_text() or "") for n, x in enumerate(pages, 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return artifacts.select("path", "content").mapInPandas(run, "path string, page int, text string")


def routed(question: Column, number: Column, identified: Column) -> Column:
    """The distinct sources a question goes to, in order; the default four if nothing is named. identified: whether it carries an
    ingredient, brand or number (a bare 'RS' means a reference standard only then)."""
    t = F.lower(F.coalesce(question, F.lit("")))
    holds = lambda *w: F.exists(F.array(*map(F.lit, w)), lambda x: F.contains(t, x))
    orange = holds("orange book", "therapeutic equivalence", "reference standard") | t.rlike(r"\bte code\b|\brld\b") | (t.rlike(r"\brs\b") & identified)
    drugs = number.isNotNull() | t.rlike(r"\b(?:nda|anda|bla)\s*#?\s*\d+") | holds("drugs@fda", "approval", "label", "sponsor", "applicant")
    package = holds("action package", "clinical review", "statistical review", "clinical pharmacology review", "cmc review", "quality review", "integrated review", "multidisciplinary review")
    guidance = holds("psg", "product-specific guidance", "bioequivalence", "be study", "dissolution")
    found = F.array_compact(F.array(F.when(orange, "orange_book"), F.when(drugs, "drugs_at_fda"), F.when(package, "action_package"), F.when(guidance, "psg"), F.when(guidance, "fda_be_guidance")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, DEFAULT)))


def requested(sources: Iterable[str]) -> list[str]:
    """Explicit sources without repeats; unapproved ones are an error."""
    out = list(dict.fromkeys(sources))
    if bad := [s for s in out if s not in SOURCES]:
        raise ValueError(f"sources outside the policy: {bad}")
    return out


def federated(*results: DataFrame | None) -> DataFrame:
    """The union of the sources' results; a source that failed (None) is left out."""
    return union_all(*(r for r in results if r is not None))


def canonical_url(url: Column, family: str) -> Column:
    """The canonical https address, or null where the policy of the family refuses it."""
    raw = F.trim(url)
    host = F.lower(F.try_parse_url(raw, F.lit("HOST")))
    authority = F.coalesce(F.try_parse_url(raw, F.lit("AUTHORITY")), F.lit(""))
    scheme = F.lower(F.try_parse_url(raw, F.lit("PROTOCOL")))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    path = F.coalesce(F.nullif(F.try_parse_url(raw, F.lit("PATH")), F.lit("")), F.lit("/"))
    query = F.try_parse_url(raw, F.lit("QUERY"))
    low = F.lower(path)
    inside = low.isin(*EXACT.get(family, ()))
    for p in PATHS[family]:
        inside = inside | F.concat(low, F.lit("/")).startswith(f"{p.rstrip('/')}/")
    dotted = F.exists(F.split(F.replace(F.coalesce(F.try_url_decode(path), F.lit("..")), F.lit("\\"), F.lit("/")), "/"), lambda s: s.isin(".", ".."))
    plain = ((scheme == "https") & port.isin("", "443")) | ((scheme == "http") & port.isin("", "80"))
    good = host.isin(*HOSTS) & ~F.contains(authority, F.lit("@")) & plain & ~dotted & inside
    www = F.when(host.startswith("www."), host).otherwise(F.concat(F.lit("www."), host))
    return F.when(good, F.concat(F.lit("https://"), www, path, F.coalesce(F.concat(F.lit("?"), query), F.lit(""))))


def assert_urls(rows: DataFrame, column: str, family: str) -> DataFrame:
    """rows, or an error when read if the policy refuses an address."""
    ok = canonical_url(F.col(column), family).isNotNull()
    return rows.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("refused address: "), F.coalesce(column, F.lit("null")))).cast("boolean")))
