"""Corpus lifecycle: discovery of artifacts, synchronisation, resolution, embedding backfill, finalisation; graph; watch; assembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, providers, sequential, variants
from ..functions.numbers import content_hash, fingerprint, shard
from ..operators import aggregates, containment, joins, merge, publish, ranking, selection, sets, windows
from . import chunking

#: Application types of the one-letter column.
PREFIX = {"N": "NDA", "A": "ANDA", "B": "BLA"}


def rendered_rows(title: Column, rows: Column, fields: list[str]) -> Column:
    """'Record i. key: value; ...' lines under a title; keys in order, empty values left out."""
    say = lambda r: F.array_join(F.filter(F.array(*(F.when(F.coalesce(r[f], F.lit("")) != "", F.concat(F.lit(f.replace("_", " ") + ": "), r[f])) for f in sorted(fields))), lambda x: x.isNotNull()), "; ")
    lines = F.transform(rows, lambda r, i: F.concat(F.lit("Record "), (i + 1).cast("string"), F.lit(". "), say(r), F.lit(".")))
    return F.array_join(F.concat(F.array(title), lines), "\n")


def book_artifacts(products: DataFrame, patents: DataFrame, exclusivities: DataFrame) -> DataFrame:
    """An artifact per application and kind of record, over the union of the three tables' keys."""
    keys = ["appl_type", "appl_no"]
    full = [t.filter("appl_type <> '' and appl_no <> ''") for t in (products, patents, exclusivities)]
    j = joins.by_key(keys, product=full[0], patent=full[1], exclusivity=full[2])
    number = F.concat(F.coalesce(F.create_map(*(F.lit(x) for kv in PREFIX.items() for x in kv))[F.col("appl_type")], "appl_type"), "appl_no")
    first = F.try_element_at("product", F.lit(1))
    out = None
    for kind, table in zip(("product", "patent", "exclusivity"), full):
        fields = [c for c in table.columns if c not in keys]
        title = F.concat(F.lit(f"Orange Book {kind} records for "), number)
        one = j.filter(F.size(kind) > 0).select(F.concat_ws(":", F.lit(f"orange-book:{kind}"), F.lower("appl_type"), "appl_no").alias("canonical_id"), F.lit("orange_book").alias("source_family"), F.lit(f"orange_book_{kind}").alias("document_type"), title.alias("title"), number.alias("application_number"), first["ingredient"].alias("active_ingredient"), F.nullif(names.canonical_name(first["ingredient"]), F.lit("")).alias("normalized_name"), F.nullif(F.split_part(first["dosage_form_route"], F.lit(";"), F.lit(1)), F.lit("")).alias("dosage_form"), F.nullif(F.split_part(first["dosage_form_route"], F.lit(";"), F.lit(2)), F.lit("")).alias("route"), rendered_rows(title, F.col(kind), fields).alias("inline_text"), F.lit(None).cast("string").alias("source_url"))
        out = one if out is None else out.unionByName(one)
    return out


def application_artifacts(applications: DataFrame, products: DataFrame, documents: DataFrame) -> DataFrame:
    """Application metadata, and every document with its type classified."""
    number = F.concat(F.coalesce("ApplType", F.lit("")), "ApplNo")
    primary = products.groupBy("ApplNo").agg(F.min_by(F.struct("ActiveIngredient", "Form"), "ProductNo").alias("_p"))
    a = applications.filter("ApplNo <> ''").join(primary, "ApplNo", "left").withColumn("application_number", number)
    ident = {"active_ingredient": F.col("_p.ActiveIngredient"), "normalized_name": F.nullif(names.canonical_name(F.col("_p.ActiveIngredient")), F.lit("")), "dosage_form": F.nullif(F.split_part("_p.Form", F.lit(";"), F.lit(1)), F.lit("")), "route": F.nullif(F.split_part("_p.Form", F.lit(";"), F.lit(2)), F.lit(""))}
    a = a.withColumns(ident)
    keep = ["application_number", *ident]
    meta = a.select(F.concat(F.lit("drugs-at-fda:application:"), F.lower("application_number")).alias("canonical_id"), F.lit("drugs_at_fda").alias("source_family"), F.lit("application_metadata").alias("document_type"), F.concat(F.lit("Drugs@FDA application "), "application_number").alias("title"), *keep, F.concat(F.lit("Sponsor: "), F.coalesce("SponsorName", F.lit(""))).alias("inline_text"), F.lit(None).cast("string").alias("source_url"))
    kind = document_type(F.col("type_id"), F.col("type_label"), F.col("title"), F.col("source_url"))
    docs = documents.join(a.select("ApplNo", *keep), "ApplNo").select(F.concat(F.lit("drugs-at-fda:document:"), "doc_key").alias("canonical_id"), F.when(kind.endswith("review"), "action_package").otherwise("drugs_at_fda").alias("source_family"), kind.alias("document_type"), "title", *keep, F.lit(None).cast("string").alias("inline_text"), "source_url")
    return meta.unionByName(docs)


def document_type(type_id: Column, label: Column, title: Column, url: Column) -> Column:
    """Conservative classification: type ids first, then wording; unclear reviews stay other_review."""
    t = F.replace(F.lower(F.concat_ws(" ", label, title, url)), F.lit("-"), F.lit(" "))
    has = lambda *w: F.exists(F.array(*map(F.lit, w)), lambda x: F.contains(t, x))
    return (
        F.when(type_id.isin("1", "12"), "approval_letter").when(type_id.isin("2", "6", "8", "11", "15", "16"), "approved_label")
        .when((type_id == "17") | has("statistical review"), "statistical_review").when(type_id.isin("18", "62") | has("clinical pharmacology", "biopharm"), "clinical_pharmacology_review")
        .when(has("chemistry review", "cmc review", "quality review", "product quality"), "cmc_quality_review").when(has("multidisciplin", "multi disciplin"), "multidisciplinary_review")
        .when(has("integrated review"), "integrated_review").when(type_id.isin("20", "58", "59") | has("clinical review", "medical review"), "clinical_review")
        .when(type_id.isin("3", "21", "57", "60", "61") | has("review"), "other_review").otherwise("regulatory_action")
    )


def guidance_artifacts(listed: DataFrame) -> DataFrame:
    number = F.lpad(F.regexp_replace("appl_no", r"\D", ""), 6, "0")
    return listed.select(F.concat(F.lit("psg:"), number).alias("canonical_id"), F.lit("psg").alias("source_family"), F.lit("product_specific_guidance").alias("document_type"), F.concat(F.lit("Product-specific guidance: "), "active_ingredient").alias("title"), number.alias("application_number"), "active_ingredient", "normalized_name", "dosage_form", "route", F.lit(None).cast("string").alias("inline_text"), F.col("pdf_url").alias("source_url"))


def discovered(*families: DataFrame) -> DataFrame:
    """The manifest: all families' artifacts with shard; a repeated canonical_id is an error when read."""
    return windows.reject_duplicates(sets.union_all(*families), "canonical_id").withColumn("shard_id", shard(F.col("canonical_id")))


def manifest_identity(artifacts: DataFrame) -> DataFrame:
    """One row: the manifest's digest (an order-free exact sum of its artifacts' fingerprints), rows, and counts by family."""
    each = artifacts.select("source_family", fingerprint(*(F.col(c) for c in sorted(artifacts.columns))).alias("f"))
    counts = each.groupBy("source_family").agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("f", 1, 15), 16, 10).cast("decimal(38,0)")).alias("x"))
    return counts.agg(F.sum("n").alias("artifacts"), F.sum("x").cast("string").alias("digest"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source_family", "n")))).alias("by_family"))


def synchronised(manifest: DataFrame, done: DataFrame, fetched: Callable[[DataFrame], DataFrame], processing: str) -> tuple[DataFrame, DataFrame]:
    """What of a manifest is still to do is fetched (canonical_id, pages), chunked and told apart from the last version.

    done: canonical_id, content_hash, processing, complete of current versions. Gives new versions (kind) and their chunks;
    complete documents of the same processing are skipped, so a repeated run does nothing."""
    todo = manifest.join(done.filter(F.col("complete") & (F.col("processing") == processing)).select("canonical_id"), "canonical_id", "left_anti")
    pages = fetched(todo).withColumn("content_hash", content_hash(F.array_join("pages", "\n\f\n")))
    last = done.select("canonical_id", F.col("content_hash").alias("_last"))
    kind = F.when(F.col("_last").isNull(), "added").when(F.col("_last") == F.col("content_hash"), "unchanged").otherwise("revised")
    versions = pages.join(last, "canonical_id", "left").withColumn("kind", kind).drop("_last")
    chunks = chunking.chunked(versions.filter("kind <> 'unchanged'"), keys=("canonical_id", "content_hash"))
    return versions.select("canonical_id", "content_hash", "kind", F.lit(processing).alias("processing")), chunks


def elected_current(versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Exactly one current version per document: one with chunks before one without, then the newest."""
    have = chunks.select("version_id").distinct().withColumn("_c", F.lit(1))
    rows = versions.join(have, "version_id", "left")
    return windows.elected(rows, "doc_id", F.desc_nulls_last("_c"), F.desc_nulls_last("fetched_at"), F.desc("version_id")).drop("_c")


def terminal_issues(rows: DataFrame, manifest_sha: str, attempts: int = 3) -> DataFrame:
    """Why a terminal resolution isn't acceptable: array issues, empty if it is."""
    e = lambda k: F.col("evidence")[k]
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    missing, broken = F.col("resolution") == "missing_at_source", F.col("resolution") == "unparseable"
    say = [
        (F.coalesce("attempts", F.lit(0)) < attempts, "too few attempts"), (F.col("resolved_at").isNull(), "no resolved_at"), (blank(F.col("error")), "no error summary"),
        (~e("manifest_sha256").eqNullSafe(F.lit(manifest_sha)), "evidence of another manifest"), (~e("canonical_id").eqNullSafe(F.col("canonical_id")), "evidence of another document"),
        (~e("source_url").eqNullSafe(F.col("source_url")), "evidence of another address"), (F.coalesce(e("attempts").cast("int"), F.lit(0)) != F.coalesce("attempts", F.lit(0)), "attempts differ"),
        (missing & ~F.col("hash_kind").eqNullSafe(F.lit("terminal_observation")), "not an observation hash"), (missing & ~e("http_status").eqNullSafe(F.lit("404")), "no exact 404"),
        (broken & ~F.col("hash_kind").eqNullSafe(F.lit("source_bytes")), "not a hash of source bytes"), (broken & (~F.coalesce("retained", F.lit(False)) | blank(F.col("artifact_uri"))), "no retained artifact"),
    ]
    listed = F.array_compact(F.array(*(F.when(c, t) for c, t in say)))
    return rows.withColumn("issues", F.when(missing | broken, listed).otherwise(F.array(F.lit("unsupported resolution"))))


def embedding_states(versions: DataFrame, chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """version_id, expected, embedded, status."""
    n = chunks.join(embedded.select("chunk_id", F.lit(1).alias("_e")), "chunk_id", "left").groupBy("version_id").agg(F.count("_e").alias("embedded"))
    j = versions.join(n, "version_id", "left").withColumn("embedded", F.coalesce("embedded", F.lit(0)))
    return j.select("version_id", F.col("chunk_count").alias("expected"), "embedded", F.when((F.col("chunk_count") > 0) & (F.col("embedded") == F.col("chunk_count")), "complete").otherwise("running").alias("status"))


def backfilled(chunks: DataFrame, embedded: DataFrame, embed=None, dim: int = 1536, provider: providers.Provider | None = None) -> DataFrame:
    """Embeddings of chunks that lack a valid one: chunk_id, content_hash, embedding (and error, from a provider). One is valid while its hash
    is the text's, so changed texts are done again and a repeated run does nothing."""
    texts = chunks.select("chunk_id", "text", content_hash(F.col("text")).alias("content_hash"))
    todo = texts.join(embedded.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_anti")
    if provider is not None:
        return providers.embedded(todo, provider, dim)
    f = embed or sequential.lifted(lambda t: sequential.hash_embedding(t, dim), "array<double>")
    return todo.select("chunk_id", "content_hash", f("text").alias("embedding"))


def valid_embeddings(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """Embeddings whose text hasn't changed since."""
    return embedded.join(chunks.select("chunk_id", content_hash(F.col("text")).alias("content_hash")), ["chunk_id", "content_hash"], "left_semi")


def swapped_profile(stored: DataFrame, new: DataFrame, old_profile: str) -> DataFrame:
    """New rows in place of an old profile's rows of the same chunks."""
    return stored.filter(F.col("profile_id") != old_profile).unionByName(stored.filter(F.col("profile_id") == old_profile).join(new.select("chunk_id"), "chunk_id", "left_anti")).unionByName(new)


def finalised(shards: DataFrame, active: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The manifest's readiness, and the active documents to retire (only meaningful when ready)."""
    return aggregates.manifest_readiness(shards), sets.retired(active, manifest, "canonical_id")


def published_manifest(table: publish.Table, shards: DataFrame, active: DataFrame, manifest: DataFrame, run: dict) -> tuple[bool, int | None]:
    """Finalises a manifest once: where all shards are ready, publishes it less what is to retire, with run and its counts as the version's
    run row. Returns whether they were ready, and the version; the same manifest again makes no version."""
    readiness, gone = finalised(shards, active, manifest)
    state = readiness.first()
    if not state["ready"]:
        return False, None
    counts = {c: state[c] for c in ("expected", "chunked", "terminal", "embedded_documents", "chunks", "embedded_chunks")} | {"retired": gone.count()}
    return True, table.publish(lambda _: manifest, run | counts)


def lifecycle_backfill(versions: DataFrame, chunks: DataFrame, embedded: DataFrame, states: DataFrame) -> DataFrame:
    """Embedding states of all versions upserted over the stored ones."""
    return merge.upserted(states, embedding_states(versions, chunks, embedded), ["version_id"])


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc_nulls_last("finished_at"), F.desc("id")).limit(1)


# --- graph -------------------------------------------------------------------------------------------------------------


def derived_graph(documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents: doc_id, version_id, appl_no, normalized_name, dosage_form, route, psg_type; chunks: doc_id, chunk_id, ordinal,
    section_path. Gives nodes, edges (HAS_PSG, HAS_SECTION, FOLLOWS) and references (member, primary)."""
    doc = F.concat(F.lit("psg_doc:"), F.col("doc_id").cast("string"))
    application = F.concat(F.lit("application:"), F.trim("appl_no"))
    d = documents.join(chunks.select("doc_id").distinct(), "doc_id", "left_semi").withColumns({"doc_node": doc, "app_node": F.when(F.trim(F.coalesce("appl_no", F.lit(""))) != "", application)})
    s = aggregates.sections_of(chunks, "doc_id").join(d.select("doc_id", "version_id", "doc_node"), "doc_id")
    s = s.withColumn("node_id", F.concat(F.lit("psg_section:"), F.col("doc_id").cast("string"), F.lit("-"), F.col("version_id").cast("string"), F.lit("-"), F.substring(F.sha2("section_path", 256), 1, 12)))
    title = F.coalesce(F.nullif(F.concat_ws(" ", *(F.nullif(F.trim(c), F.lit("")) for c in ("normalized_name", "dosage_form", "route"))), F.lit("")), F.concat(F.lit("PSG doc "), F.col("doc_id").cast("string")))
    kind = F.when(F.coalesce("psg_type", F.lit("")) != "", F.concat(F.lit(" PSG ("), "psg_type", F.lit(")"))).otherwise("")
    nodes = (
        d.select(F.col("doc_node").alias("node_id"), F.lit("psg_doc").alias("node_type"), F.concat(title, kind).alias("name"))
        .union(d.filter("app_node is not null").select("app_node", F.lit("application"), F.concat(F.lit("Application "), F.trim("appl_no"))).distinct())
        .union(s.select("node_id", F.lit("psg_section"), "section_path"))
    )
    edges = (
        d.filter("app_node is not null").select(F.col("app_node").alias("src"), F.col("doc_node").alias("dst"), F.lit("HAS_PSG").alias("edge_type"))
        .union(s.select("doc_node", "node_id", F.lit("HAS_SECTION"))).union(windows.follows(s).select("src", "dst", F.lit("FOLLOWS")))
    )
    c = chunks.join(d.select("doc_id", "doc_node", "app_node"), "doc_id").withColumn("_o", F.coalesce("ordinal", F.lit(0)))
    member = c.select(F.col("doc_node").alias("node_id"), "chunk_id", F.lit("member").alias("ref_type"), F.col("_o").alias("rank"))
    member = member.union(c.join(s.select("doc_id", "section_path", "node_id"), ["doc_id", "section_path"]).select("node_id", "chunk_id", F.lit("member"), "_o"))
    primary = member.groupBy("node_id").agg(F.min_by("chunk_id", F.struct("rank", "chunk_id")).alias("chunk_id")).select("node_id", "chunk_id", F.lit("primary").alias("ref_type"), F.lit(0).alias("rank"))
    return nodes, edges, member.union(primary)


# --- watch -------------------------------------------------------------------------------------------------------------


def alerts(pairs: DataFrame, versions: DataFrame, stored: DataFrame) -> DataFrame:
    """pairs: appl_no, doc_id, product_id, confidence, rationale. Alerts of documents that have a version, those not yet stored."""
    last = joins.latest(versions, "doc_id", "captured_at", "version_id")
    made = pairs.filter("product_id is not null").join(last.select("doc_id", "version_id", "captured_at", "diff_summary"), "doc_id")
    return merge.inserted(stored, made, ["version_id", "appl_no", "product_id"])


def watched(listed: DataFrame, products: DataFrame, documents: DataFrame, versions: DataFrame, stored: DataFrame, fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """listed: listing_id, appl_no, name, route, dosage_form, content_hash. Crawled rows -> matches -> change kinds -> alerts of
    changed and of missed pairs; and a ledger row of counts. A second run over its own results gives no alerts."""
    matches = joins.cascade(listed, products, fuzzy).join(listed.select("listing_id", "appl_no", "content_hash"), "listing_id")
    kinds = sets.change_kinds(listed.select(F.col("appl_no").alias("doc_key"), "content_hash"), versions.select("doc_key", "content_hash", "captured_at", "version_id"))
    j = matches.join(kinds.select(F.col("doc_key").alias("appl_no"), "kind").distinct(), "appl_no").join(documents.select("doc_id", "appl_no"), "appl_no")
    missed = joins.missed_alerts(j.select("doc_id", "product_id").distinct(), versions.select("doc_id", "version_id", "captured_at"), stored).select("doc_id", "product_id")
    due = j.filter(F.col("kind").isin("added", "revised")).select("doc_id", "product_id").union(missed).distinct()
    made = alerts(j.join(due, ["doc_id", "product_id"], "left_semi"), versions, stored)
    ledger = kinds.groupBy().agg(F.count("*").alias("scanned"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("added", "revised", "unchanged", "error")))
    return made, ledger


def company_watchlist(applications: DataFrame, products: DataFrame, statuses: DataFrame, aliases: list[str]) -> DataFrame:
    """The company's products by sponsor alias, distinct by (name, form, route, number); approved before discontinued before
    tentative."""
    wanted = [a.strip().upper() for a in aliases if a.strip()]
    mine = applications.filter(F.upper(F.trim("SponsorName")).isin(wanted)).select("ApplNo", F.concat(F.coalesce("ApplType", F.lit("")), "ApplNo").alias("number"))
    s = F.lower("MarketingStatusDescription")
    rank = F.when(F.contains(s, F.lit("prescription")), 1).when(F.contains(s, F.lit("discontinued")), 2).when(F.contains(s, F.lit("tentative")) | (s == "none"), 3)
    st = statuses.groupBy("ApplNo", "ProductNo").agg(F.min(rank).alias("_r"))
    p = products.filter("ActiveIngredient <> ''").join(mine, "ApplNo").join(st, ["ApplNo", "ProductNo"], "left")
    part = lambda n: F.nullif(F.split_part("Form", F.lit(";"), F.lit(n)), F.lit(""))
    p = p.select(F.col("ActiveIngredient").alias("active_ingredient"), names.canonical_name(F.col("ActiveIngredient")).alias("normalized_name"), part(1).alias("dosage_form"), part(2).alias("route"), "number", "ProductNo", F.when(F.col("_r") == 1, "approved").when(F.col("_r") == 2, "discontinued").when(F.col("_r") == 3, "tentative").alias("company_status"))
    return sets.first_seen(p, ["normalized_name", "dosage_form", "route", "number"], "ProductNo")


def sponsor_aliases(applications: DataFrame, root: str) -> DataFrame:
    name = F.upper(F.trim("SponsorName"))
    return applications.filter(F.contains(name, F.lit(root.upper()))).select(name.alias("alias")).distinct().orderBy("alias")


def recent_digest(alerts_: DataFrame, versions: DataFrame, since: str | None, limit: int, offset: int = 0) -> DataFrame:
    """Alerts newest first, since inclusive and before the limit, with change_kind: new for a document's first version, and
    total: how many there are since."""
    first = versions.groupBy("doc_id").agg(F.min("version_id").alias("_first"))
    rows = alerts_ if since is None else alerts_.filter(F.to_timestamp("captured_at") >= F.to_timestamp(F.lit(since)))
    rows = ranking.counted_page(rows, [F.desc(F.to_timestamp("captured_at")), F.desc("alert_id")], limit, offset)
    return rows.join(first, "doc_id", "left").withColumn("change_kind", F.when(F.col("version_id") == F.col("_first"), "new").otherwise("revised")).drop("_first")


# --- dossier and white paper ----------------------------------------------------------------------------------------------

#: Requirement fields in order, with their checklist labels.
FIELDS = {"study_type": "Study type", "study_design": "Study design", "strengths": "Strengths covered", "dissolution": "Dissolution", "waiver_conditions": "Waiver conditions", "additional_notes": "Notes"}


def checklist(requirements: DataFrame) -> DataFrame:
    """requirements: doc_id, fields (map). doc_id, position, field, item in fixed order, blank fields left out."""
    items = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(f).alias("field"), F.concat(F.lit(f"{label}: "), F.col("fields")[f]).alias("item")) for i, (f, label) in enumerate(FIELDS.items())))
    return requirements.select("doc_id", F.explode(F.filter(items, lambda x: F.coalesce(F.col("fields")[x["field"]], F.lit("")) != "")).alias("x")).select("doc_id", "x.*")


def unpivoted(requirements: DataFrame, labels: DataFrame, payload: str = "fields_json") -> DataFrame:
    """doc_id, field, label, value of a JSON object's fields; blanks and fields without a label are left out."""
    each = variants.fields(requirements.select("doc_id", variants.parsed(F.col(payload)).alias("_v")), "_v").select("doc_id", F.col("key").alias("field"), variants.at(F.col("value"), "$").alias("value"))
    return each.filter("trim(value) <> ''").join(labels, "field").select("doc_id", "field", "label", "value")


def dossier(asked: DataFrame, documents: DataFrame, versions: DataFrame, requirements: DataFrame) -> DataFrame:
    """asked: ask_id, ingredient, form. Matching documents with their latest version's summary and latest requirement's fields."""
    a = asked.select("ask_id", F.col("form").alias("_want"), names.canonical_name(F.col("ingredient")).alias("_c"), names.stripped_name(F.col("ingredient")).alias("_s"))
    d = documents.withColumn("_ds", names.stripped_name(F.col("active_ingredient")))
    hit = a.join(d, F.col("_c") == F.col("normalized_name")).filter("_c <> ''").union(a.join(d, F.col("_s") == F.col("_ds")).filter("_s <> ''")).distinct()
    hit = hit.filter(names.forms_match(F.col("_want"), F.col("dosage_form"))).drop("_want", "_c", "_s", "_ds")
    v = joins.latest(versions, "doc_id", "captured_at", "version_id").select("doc_id", "version_id", "diff_summary")
    r = joins.latest(requirements, "doc_id", "version_id", "requirement_id").select("doc_id", "fields")
    return hit.join(v, "doc_id", "left").join(r, "doc_id", "left")


#: Cells of the white paper with mode, and the extractor's kind here.
CELLS = {
    "product_name": "auto", "dosage_form": "auto", "route": "auto", "strengths": "auto", "rd_center": "manual", "priority_status": "manual", "patents": "manual",
    "first_to_market": "manual", "eftf": "manual", "drug_shortage": "auto", "combination_product": "manual", "rld": "auto", "rs": "auto", "proprietary_name": "auto",
    "rld_strength": "auto", "nda_number": "auto", "nda_holder": "auto", "indication": "evidence_only", "rems": "auto", "restricted_distribution": "manual",
    "labeling_images": "evidence_only", "epc": "evidence_only", "plr_format": "evidence_only", "usp_monograph": "manual", "pllr_format": "evidence_only",
    "pregnancy_registry": "evidence_only", "salable_unit": "manual", "packaging": "auto", "labeling_carveouts": "manual", "emergency_use": "manual",
    "dea_classification": "evidence_only", "be_guidance_available": "auto", "requirements": "evidence_only", "proposed_strategy": "manual", "in_vivo_be_studies": "manual",
    "q1_q2_assessment": "manual", "tablet_scoring": "manual", "threshold_analysis": "manual", "human_factor_studies": "manual", "dissolution_testing": "manual",
    "biocompatibility_studies": "manual", "toxicology_studies": "manual", "prepared_by": "manual", "reviewed_by": "manual", "labeling_approved_by": "manual", "approved_by": "manual",
}


#: Label sections of the cells that quote one, those that make the PLR and the PLLR format, and how many of the former suffice.
QUOTED = {"indication": ("34067-9",), "packaging": ("34069-5",), "epc": ("34090-1",), "dea_classification": ("34085-1", "42227-9")}
PLR, PLR_LEAST, PLLR = ("43683-2", "34067-9", "34068-7", "43678-2", "34070-3", "34071-1", "34084-4"), 4, ("42228-7", "77290-5", "77291-3")
REGISTRY = r"(?i)[^.]*pregnancy (?:exposure )?registry[^.]*\.?"
YES = ("YES", "Y", "RLD", "RS", "TBD")
POPULATED, ABSENT, ANALYST = "populated", "verified_absent", "analyst_input_required"


def _cell(status: Column | str, value: Column | None = None, evidence: Column | None = None) -> Column:
    kind = "struct<status:string,value:string,evidence:array<string>>"
    parts = (F.lit(status) if isinstance(status, str) else status, F.lit(None) if value is None else value, F.lit(None) if evidence is None else evidence)
    return F.struct(*(x.alias(n) for x, n in zip(parts, ("status", "value", "evidence")))).cast(kind)


def _values(column: Column) -> Column:
    """Distinct filled values of a group, in order; a product has few."""
    return F.array_sort(F.collect_set(F.nullif(names.squeeze(column), F.lit(""))))


def _listed(values: Column) -> Column:
    return _cell(F.when(F.size(values) > 0, POPULATED).otherwise(ANALYST), F.nullif(F.array_join(values, "; "), F.lit("")))


def _programs(products: DataFrame, programs: DataFrame) -> DataFrame:
    """number, confirmed, alike: whether a safety program names the application, and programs whose names hold its ingredient or trade name."""
    own = products.select("number", F.explode(F.array_distinct(F.array(*(F.lower(names.squeeze(c)) for c in ("ingredient", "trade_name"))))).alias("needle")).filter("needle <> ''").distinct()
    texts = programs.select(F.col("name").alias("text_id"), F.lower("name").alias("text")).distinct()
    met = own.join(containment.contained(own, texts), "needle").select("number", F.col("text_id").alias("name")).distinct().join(programs.select("name", F.col("number").alias("_n")), "name")
    return met.groupBy("number").agg(F.bool_or(F.coalesce(names.application_number(F.col("_n")) == names.application_number(F.col("number")), F.lit(False))).alias("confirmed"), F.array_sort(F.collect_set("name")).alias("alike"))


def white_paper(
    products: DataFrame, patents: DataFrame, exclusivities: DataFrame, guidances: DataFrame, sections: DataFrame,
    shortages: DataFrame | None = None, programs: DataFrame | None = None, media: DataFrame | None = None, requirements: DataFrame | None = None,
) -> DataFrame:
    """A row per application (number) and cell: status, value, evidence. products: number, ingredient, df_route, trade_name,
    strength, applicant, rld, rs; patents: number, patent_no; exclusivities: number, code; guidances: number; sections: number,
    code, text (label sections by code); shortages: number, status; programs (safety programs): name, number or null; media (label
    pages): number, page; requirements (of guidances): number, text.

    Every source is aggregated once by application and the cells are one array. A source that wasn't in the snapshot is no
    evidence of absence: its cells go to the analyst, as do programs that share only a name."""
    p = products.groupBy("number").agg(
        *(_values(F.col(c)).alias(c) for c in ("ingredient", "strength", "trade_name", "applicant")), _values(F.split_part("df_route", F.lit(";"), F.lit(1))).alias("form"), _values(F.split_part("df_route", F.lit(";"), F.lit(2))).alias("route"),
        *(F.bool_or(F.coalesce(F.upper(F.trim(c)).isin(*YES), F.lit(False))).alias(c) for c in ("rld", "rs")),
    )
    coded = lambda codes: F.when(F.col("code").isin(*codes), F.col("code"))
    s = sections.groupBy("number").agg(
        *(F.max_by("text", F.when(F.col("code").isin(*codes), F.length("text"))).alias(cell) for cell, codes in QUOTED.items()), F.count_distinct(coded(PLR)).alias("plr"), F.count_distinct(coded(PLLR)).alias("pllr"),
        F.max(F.nullif(F.regexp_extract(F.when(F.col("code") == "42228-7", F.col("text")), REGISTRY, 0), F.lit(""))).alias("registry"),
    )
    every = [s, patents.groupBy("number").agg(_values(F.col("patent_no")).alias("patents")), exclusivities.groupBy("number").agg(_values(F.col("code")).alias("codes")), guidances.select("number", F.lit(True).alias("guided")).distinct()]
    if shortages is not None:
        every.append(shortages.groupBy("number").agg(_values(F.col("status")).alias("shortage"), F.lit(True).alias("short")))
    if programs is not None:
        every.append(_programs(products, programs))
        known = not programs.isEmpty()
    if media is not None:
        every.append(media.groupBy("number").agg(F.transform(F.array_sort(F.collect_set("page")), lambda x: F.concat(F.lit("page "), x.cast("string"))).alias("images")))
    if requirements is not None:
        every.append(requirements.groupBy("number").agg(F.array_sort(F.collect_set(F.nullif(F.trim("text"), F.lit("")))).alias("required")))
    for other in every:
        p = selection.null_safe(p, other, ["number"], "left")
    c = F.col
    flag = lambda x: _cell(F.when(c(x), POPULATED).otherwise(ABSENT), F.when(c(x), "Yes"))
    told = lambda ok, value: _cell(F.when(ok, POPULATED).otherwise(ANALYST), F.when(ok, value))
    cells = {
        "product_name": _listed(c("ingredient")), "dosage_form": _listed(c("form")), "route": _listed(c("route")), "strengths": _listed(c("strength")), "rld_strength": _listed(c("strength")),
        "proprietary_name": _listed(c("trade_name")), "nda_holder": _listed(c("applicant")), "nda_number": told(c("number") != "", c("number")), "rld": flag("rld"), "rs": flag("rs"),
        "be_guidance_available": _cell(F.when(c("guided"), POPULATED).otherwise(ABSENT), F.when(c("guided"), "Yes")),
        "plr_format": told(F.coalesce(c("plr"), F.lit(0)) >= PLR_LEAST, F.lit("PLR format")), "pllr_format": told(F.coalesce(c("pllr"), F.lit(0)) == len(PLLR), F.lit("PLLR format")),
        "pregnancy_registry": told(c("registry").isNotNull(), c("registry")), "patents": _cell(ANALYST, None, c("patents")),
    } | {cell: told(c(cell).isNotNull(), c(cell)) for cell in QUOTED} | {cell: _cell(ANALYST, None, c("codes")) for cell in ("first_to_market", "eftf", "priority_status")}
    if shortages is not None:
        listed = F.array_join("shortage", "; ")
        over = (F.size("shortage") > 0) & F.forall("shortage", lambda x: F.contains(F.lower(x), F.lit("resolved")))
        value = F.when(over, F.concat(listed, F.lit(" — historical shortage record(s); no current shortage status returned."))).when(F.size("shortage") > 0, F.concat(F.lit("Yes — "), listed)).otherwise("Yes")
        cells["drug_shortage"] = _cell(F.when(c("short"), POPULATED).otherwise(ABSENT), F.when(c("short"), value), c("shortage"))
    if programs is not None:
        named = (F.size("ingredient") > 0) | (F.size("trade_name") > 0)
        cells["rems"] = _cell(F.when(~named | ~F.lit(known), ANALYST).when(c("confirmed"), POPULATED).when(c("alike").isNotNull(), ANALYST).otherwise(ABSENT), F.when(named & c("confirmed"), "Yes"), c("alike"))
    if media is not None:
        cells["labeling_images"] = _cell(F.when(c("images").isNotNull(), POPULATED).otherwise(ANALYST), F.when(c("images").isNotNull(), F.concat(F.size("images").cast("string"), F.lit(" label pages"))), c("images"))
    if requirements is not None:
        some = F.coalesce(F.size("required") > 0, F.lit(False))
        cells["requirements"] = _cell(F.when(some, POPULATED).otherwise(ANALYST), F.when(some, F.array_join("required", "\n")), c("required"))
    rows = F.array(*(F.struct(F.lit(cell).alias("cell_id"), F.lit(mode).alias("mode"), cells.get(cell, _cell(ANALYST)).alias("c")) for cell, mode in CELLS.items()))
    out = p.select("number", F.explode(rows).alias("r"))
    return out.select("number", "r.cell_id", "r.mode", "r.c.status", F.when(F.col("r.mode") != "manual", F.col("r.c.value")).alias("value"), "r.c.evidence")


def reviews_of(products: DataFrame, documents: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """Review packages of the applications that match: joined, of the family, in total order, limited."""
    hit = joins.applications(asked, products)
    return documents.filter("source_family = 'action_package'").join(hit, "appl_no").orderBy("appl_no", "document_type", "canonical_id").limit(limit)
