"""Retrieval over a versioned corpus: filters, current versions, exact top-k, tripwires, scopes, label sections."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequential
from ..functions.names import application_number, citation_label
from ..functions.text import content_tokens, jaccard
from ..operators.filters import all_of, assert_mode, compile_filter, default_mode, in_namespaces, stored_casing, without_blanks
from ..operators.joins import latest
from ..operators.ranking import best_occurrence, top_k
from ..tables import small
from . import chunking


def folded(chunks: DataFrame, where: Mapping[str, Any], fields: Mapping[str, str]) -> dict[str, Any]:
    """where with text values in the one spelling the corpus stores; unclear ones stay. The values are a few literals."""
    out = dict(where)
    for key, value in where.items():
        if fields.get(key) == "text" and isinstance(value, str):
            asked = chunks.sparkSession.createDataFrame([(value,)], "value string")
            out[key] = stored_casing(chunks, key, asked).first()["stored"]
    return out


def current_versions(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """doc_id, version_id of each document's latest version."""
    return documents.select("doc_id").join(latest(versions, "doc_id", "captured_at", "version_id"), "doc_id").select("doc_id", "version_id")


def retrieve(chunks: DataFrame, current: DataFrame | None, query: list[float], k: int, where: Mapping[str, Any] | None = None, fields: Mapping[str, str] | None = None, families: list[str] | None = None, mode: str | None = None) -> DataFrame:
    """The k nearest chunks under the filters, of current versions only. The filters are pushed below the distance."""
    flat = without_blanks(where or {})
    assert_mode(mode or default_mode(flat), flat)
    predicate = compile_filter(flat, fields or {})
    if families is not None:
        predicate = all_of([predicate, in_namespaces("source_family", families)])
    rows = chunks.filter(predicate)
    if current is not None:
        rows = rows.join(current.select("version_id"), "version_id", "left_semi")
    out = top_k(rows, query, k)
    return out.withColumn("short_name", citation_label(F.col("short_name"), F.col("appl_no"), F.col("normalized_name"))) if {"short_name", "appl_no", "normalized_name"} <= set(out.columns) else out


def tripwires(passages: DataFrame, query: str = "query_id") -> DataFrame:
    """query and decision: mixed_products for several products, multi_form for several (form, route) pairs, else ok; rows without
    the metadata don't count."""
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    pair = F.when(full("dosage_form").isNotNull() & full("route").isNotNull(), F.struct("dosage_form", "route"))
    n = passages.groupBy(query).agg(F.count_distinct(full("normalized_name")).alias("p"), F.count_distinct(pair).alias("f"))
    return n.select(query, F.when(F.col("p") > 1, "mixed_products").when(F.col("f") > 1, "multi_form").otherwise("ok").alias("decision"))


def form_combinations(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Distinct (name, form, route) of documents that have a version; half-known pairs are skipped."""
    have = documents.join(versions.select("doc_id").distinct(), "doc_id", "left_semi")
    return have.filter("dosage_form <> '' and route <> ''").select("normalized_name", "dosage_form", "route").distinct().orderBy("normalized_name", "dosage_form", "route")


#: Documents that a policy covers at most, and that any setting may allow.
POLICY_MOST, SCOPE_MOST = 64, 512


def policy_scope(documents: DataFrame, versions: DataFrame, part: str = "inhal", most: int = POLICY_MOST, hard: int = SCOPE_MOST) -> DataFrame:
    """Documents whose route contains part, each with its latest version; it fails closed: a missing number or version, a hash
    that differs, or more than most documents is an error when read."""
    if not 0 < most <= hard:
        raise ValueError(f"a policy covers 1 to {hard} documents")
    hit = documents.filter(F.contains(F.lower(F.coalesce("route", F.lit(""))), F.lit(part)))
    last = latest(versions.select("doc_id", "version_id", "captured_at", F.col("content_hash").alias("version_hash")), "doc_id", "captured_at", "version_id")
    j = hit.join(last, "doc_id", "left")
    n = hit.agg(F.count("*").alias("_n"))
    wrong = (
        F.when(F.col("_n") > most, F.lit("the policy covers too many documents"))
        .when(F.trim(F.coalesce("appl_no", F.lit(""))) == "", F.lit("a document has no application number"))
        .when(F.col("version_id").isNull(), F.lit("a document has no current version"))
        .when((F.coalesce("content_hash", F.lit("")) == "") | (F.col("content_hash") != F.col("version_hash")), F.lit("a document's hash differs from its version's"))
    )
    j = j.crossJoin(small(n, 1)).withColumn("_w", wrong)
    ok = j.filter(F.when(F.col("_w").isNotNull(), F.raise_error(F.col("_w")).cast("boolean")).otherwise(F.lit(True)))
    return ok.select("doc_id", "version_id", F.trim("appl_no").alias("appl_no"), F.concat(F.lit("PSG_"), F.trim("appl_no")).alias("short_name"))


def redundancy(sentences: DataFrame, answer: str = "answer_id", position: str = "position", text: str = "text") -> DataFrame:
    """The largest Jaccard of two sentences of each answer (0 for fewer), and the flag from 0.6. An answer's sentences are few."""
    t = sentences.select(answer, position, content_tokens(F.col(text)).alias("t"))
    pairs = t.alias("a").join(t.alias("b"), (F.col(f"a.{answer}") == F.col(f"b.{answer}")) & (F.col(f"a.{position}") < F.col(f"b.{position}")))
    most = pairs.groupBy(F.col(f"a.{answer}").alias(answer)).agg(F.max(jaccard(F.col("a.t"), F.col("b.t"))).alias("redundancy"))
    out = sentences.select(answer).distinct().join(most, answer, "left").withColumn("redundancy", F.coalesce("redundancy", F.lit(0.0)))
    return out.withColumn("redundant", F.col("redundancy") >= 0.6)


def ordered_chunks(chunks: DataFrame, document: Column | None = None) -> DataFrame:
    """Chunks in order for re-derivation: missing ordinals last, page 1 by default, blank texts left out."""
    rows = chunks if document is None else chunks.filter(document)
    rows = rows.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return rows.withColumns({"ordinal": F.coalesce("ordinal", F.lit(2147483647)), "page": F.coalesce("page", F.lit(1))}).orderBy("ordinal", "chunk_id")


def latest_label(documents: DataFrame, versions: DataFrame, chunks: DataFrame, number: str) -> DataFrame:
    """The newest approved label of an application that has chunks: one row."""
    want = application_number(F.lit(number))
    mine = documents.filter(F.col("is_active") & (F.col("document_type") == "approved_label") & (application_number(F.col("application_number")) == want))
    have = versions.join(chunks.select("version_id").distinct(), "version_id", "left_semi")
    return mine.join(have, "doc_id").orderBy(F.desc_nulls_last("source_updated_at"), F.desc("fetched_at"), F.desc("version_id"), F.desc("doc_id")).limit(1)


def merged_pages(chunks: DataFrame, least: int = 80, most: int = 4000) -> DataFrame:
    """version_id, page, text: a page's chunks in order, their overlaps taken out."""

    def join(parts: list) -> str:
        out = ""
        for p in parts:
            more = sequential.without_overlap(out, p, least, most)
            out = p if not out else out + more if len(more) < len(p) else f"{out}\n{p}"
        return out

    rows = chunks.groupBy("version_id", F.coalesce("page", F.lit(1)).alias("page")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "chunk_id", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("parts"))
    return rows.select("version_id", "page", sequential.lifted(lambda p: join(list(p)), "string")("parts").alias("text"))


def label_sections(pages: DataFrame, headings: Mapping[str, str], budget: int = 4000) -> DataFrame:
    """version_id, code, page, text: the longest occurrence of each heading (code -> pattern), to the next numbered heading or the
    budget, running over onto the following page."""
    nxt = F.lead("text").over(Window.partitionBy("version_id").orderBy("page"))
    hay = pages.withColumn("hay", F.concat_ws("\n", "text", nxt))
    rows = None
    for code, pattern in headings.items():
        body = rf"(?ms)^\s*(?:\d+(?:\.\d+)?\s+)?{pattern}.*?(?=^\s*\d{{1,2}}(?:\.\d+)?\s+[A-Z]|\z)"
        one = hay.select("version_id", "page", F.lit(code).alias("code"), F.explode(F.regexp_extract_all("hay", F.lit(body), F.lit(0))).alias("text"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.withColumn("text", F.trim(F.substring("text", 1, budget))).filter("text <> ''")
    return best_occurrence(rows, "version_id", "code")


def chunked(documents: DataFrame, strip: bool = False) -> DataFrame:
    """documents: doc_id, pages (array) -> doc_id, chunk_id, page, section_path, ordinal, text."""
    return chunking.chunked(documents, strip).select("doc_id", F.concat_ws("-", "doc_id", "ordinal").alias("chunk_id"), "page", "section_path", "ordinal", "text")
