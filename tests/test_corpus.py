"""The life of a corpus: manifest, synchronisation, terminal documents, embeddings, finalising, watchlists."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates, publish
from tessera.plans import corpus


@pytest.fixture(scope="module")
def manifest(spark):
    frame = spark.createDataFrame
    book = corpus.book_artifacts(
        frame([("N", "000001", "001", "ZINC SULFATE", "TABLET;ORAL", "Zincor"), ("N", "000001", "002", "ZINC SULFATE", "TABLET;ORAL", ""), ("A", "000002", "001", "IRON", "GEL;TOPICAL", "Fe")], "appl_type string, appl_no string, product_no string, ingredient string, dosage_form_route string, trade_name string"),
        frame([("N", "000001", "1234567"), ("N", "", "1")], "appl_type string, appl_no string, patent_no string"),
        frame([("B", "000009", "NCE")], "appl_type string, appl_no string, exclusivity_code string"),
    )
    applications = corpus.application_artifacts(
        frame([("NDA", "000001", "Maker"), ("ANDA", "000002", None), ("NDA", "", "x")], "ApplType string, ApplNo string, SponsorName string"),
        frame([("000001", "002", "other", "X;Y"), ("000001", "001", "Zinc Sulfate", "TABLET;ORAL")], "ApplNo string, ProductNo string, ActiveIngredient string, Form string"),
        frame([("000001", "d1", "18", "", "Review", "https://x/1"), ("000001", "d2", "2", "Label", "Label", "https://x/2"), ("000002", "d3", "99", "Medical Review", "", "https://x/3")], "ApplNo string, doc_key string, type_id string, type_label string, title string, source_url string"),
    )
    guidances = corpus.guidance_artifacts(frame([("1", "Zinc", "zinc", "TABLET", "ORAL", "https://x/g.pdf")], "appl_no string, active_ingredient string, normalized_name string, dosage_form string, route string, pdf_url string"))
    return book, applications, guidances


def test_manifest(spark, manifest):
    whole = corpus.discovered(*manifest)
    rows = {r.canonical_id: r for r in whole.collect()}
    assert set(rows) == {
        "orange-book:product:n:000001", "orange-book:product:a:000002", "orange-book:patent:n:000001", "orange-book:exclusivity:b:000009", "psg:000001",
        "drugs-at-fda:application:nda000001", "drugs-at-fda:application:anda000002", "drugs-at-fda:document:d1", "drugs-at-fda:document:d2", "drugs-at-fda:document:d3",
    }
    product = rows["orange-book:product:n:000001"]
    assert product.inline_text == "Orange Book product records for NDA000001\nRecord 1. dosage form route: TABLET;ORAL; ingredient: ZINC SULFATE; product no: 001; trade name: Zincor.\nRecord 2. dosage form route: TABLET;ORAL; ingredient: ZINC SULFATE; product no: 002."
    assert (product.normalized_name, product.dosage_form, product.route, product.application_number) == ("zinc sulfate", "TABLET", "ORAL", "NDA000001")
    kinds = {k: (r.source_family, r.document_type) for k, r in rows.items() if "document:" in k}
    assert list(kinds.values()) and kinds["drugs-at-fda:document:d1"] == ("action_package", "clinical_pharmacology_review") and kinds["drugs-at-fda:document:d2"] == ("drugs_at_fda", "approved_label") and kinds["drugs-at-fda:document:d3"] == ("action_package", "clinical_review")
    assert rows["drugs-at-fda:application:nda000001"].normalized_name == "zinc sulfate" and all(0 <= r.shard_id < 512 for r in rows.values())
    one, again = corpus.manifest_identity(whole).first(), corpus.manifest_identity(whole.repartition(7).orderBy(F.desc("title"))).first()
    assert one == again and one.artifacts == 10 and one.by_family == {"action_package": 2, "drugs_at_fda": 3, "orange_book": 4, "psg": 1}
    assert corpus.manifest_identity(whole.filter("canonical_id <> 'psg:000001'")).first().digest != one.digest
    with pytest.raises(Exception):
        corpus.discovered(*manifest, manifest[2]).collect()


def test_synchronisation(spark):
    todo = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "canonical_id string")
    text = {"a": ["Page one."], "b": ["B was revised."], "c": ["same"], "d": ["New.", None, "Last."]}
    fetched = lambda df: df.withColumn("pages", F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)).cast("array<string>") for kv in text.items() for x in kv))[F.col("canonical_id")])
    digest = lambda pages: spark.range(1).select(F.sha2(F.array_join(F.array(*map(F.lit, pages)).cast("array<string>"), "\n\f\n"), 256)).first()[0]
    done = spark.createDataFrame([("a", "x", "v1", True), ("b", "old", "v0", True), ("c", digest(["same"]), "v1", False)], "canonical_id string, content_hash string, processing string, complete boolean")
    versions, chunks = corpus.synchronised(todo, done, fetched, "v1")
    assert {r.canonical_id: r.kind for r in versions.collect()} == {"b": "revised", "c": "unchanged", "d": "added"}
    assert sorted((r.canonical_id, r.page, r.text) for r in chunks.collect()) == [("b", 1, "B was revised."), ("d", 1, "New."), ("d", 3, "Last.")]
    after = versions.select("canonical_id", "content_hash", "processing", F.lit(True).alias("complete")).union(done.filter("canonical_id = 'a'"))
    again, _ = corpus.synchronised(todo, after, fetched, "v1")
    assert again.count() == 0
    assert corpus.synchronised(todo, after, fetched, "v2")[0].filter("kind = 'unchanged'").count() == 3  # another processing looks again


def test_terminal_documents(spark):
    schema = "canonical_id string, resolution string, attempts int, resolved_at string, error string, source_url string, hash_kind string, retained boolean, artifact_uri string, evidence map<string,string>"
    proof = lambda **more: {"manifest_sha256": "m", "canonical_id": "a", "source_url": "u", "attempts": "3"} | more
    rows = [
        ("a", "missing_at_source", 3, "t", "gone", "u", "terminal_observation", None, None, proof(http_status="404")), ("a", "unparseable", 3, "t", "bad", "u", "source_bytes", True, "s3://x", proof()),
        ("a", "missing_at_source", 2, None, " ", "u", "source_bytes", None, None, proof(http_status="410")), ("a", "unparseable", 3, "t", "bad", "v", "source_bytes", False, "", proof(manifest_sha256="n")), ("a", "indexed", 3, "t", "e", "u", None, None, None, None),
    ]
    got = [r.issues for r in corpus.terminal_issues(spark.createDataFrame(rows, schema), "m").collect()]
    assert got[:2] == [[], []] and got[4] == ["unsupported resolution"]
    assert got[2] == ["too few attempts", "no resolved_at", "no error summary", "attempts differ", "not an observation hash", "no exact 404"]
    assert got[3] == ["evidence of another manifest", "evidence of another address", "no retained artifact"]


def test_embeddings_follow_texts(spark):
    chunks = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "chunk_id long, text string")
    first = corpus.backfilled(chunks, spark.createDataFrame([], "chunk_id long, content_hash string"), dim=64)
    stored = spark.createDataFrame(first.collect(), first.schema)
    assert corpus.backfilled(chunks, stored).count() == 0
    changed = chunks.withColumn("text", F.when(F.col("chunk_id") == 2, "other").otherwise(F.col("text")))
    assert [r.chunk_id for r in corpus.backfilled(changed, stored, dim=64).collect()] == [2]
    assert sorted(r.chunk_id for r in corpus.valid_embeddings(changed, stored).collect()) == [1, 3]
    versions = spark.createDataFrame([(10, 2), (11, 1), (12, 0)], "version_id long, chunk_count long")
    of = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "chunk_id long, version_id long")
    state = {r.version_id: (r.embedded, r.status) for r in corpus.embedding_states(versions, of, corpus.valid_embeddings(changed, stored)).collect()}
    assert state == {10: (1, "running"), 11: (1, "complete"), 12: (0, "running")}


def test_finalised_once(spark, tmp_path):
    table = publish.Table(spark, str(tmp_path / "manifest"))
    shard = "shard int, expected long, chunked long, terminal long, missing_at_source long, embedded_documents long, chunks long, embedded_chunks long, issues array<string>"
    ready = spark.createDataFrame([(0, 2, 2, 0, 0, 2, 5, 5, []), (1, 1, 0, 1, 1, 0, 0, 0, [])], shard)
    manifest = spark.createDataFrame([("a",), ("b",), ("c",)], "canonical_id string")
    active = spark.createDataFrame([("a",), ("z",)], "canonical_id string")
    open_ = ready.withColumn("issues", F.when(F.col("shard") == 1, F.array(F.lit("c: embeddings incomplete"))).otherwise(F.col("issues")))
    assert corpus.published_manifest(table, open_, active, manifest, {"id": 1}) == (False, None) and table.read() is None
    assert corpus.published_manifest(table, ready, active, manifest, {"id": 2}) == (True, 0)
    assert corpus.published_manifest(table, ready, active, manifest.orderBy(F.desc("canonical_id")), {"id": 3}) == (True, 0)  # the same manifest
    (run,) = table.runs().collect()
    assert '"id": 2' in run.run and '"retired": 1' in run.run and '"expected": 3' in run.run


def test_blockers(spark):
    run = "struct<expected:long,discovered:long,added:long,revised:long,unchanged:long,terminal:long,errors:long>"
    families = spark.createDataFrame([("psg", 3), ("orange_book", 0)], "key string, documents long")

    def blockers(complete, documents, terminal, value):
        status = spark.createDataFrame([(complete, documents, terminal, value)], f"complete boolean, documents long, terminal_documents long, run {run}")
        return aggregates.blockers(status, families, ["psg"]).first().blockers

    assert blockers(True, 9, 1, (10, 10, 3, 2, 4, 1, 0)) == []
    assert blockers(False, 9, 1, None) == ["embedding coverage or source policy is incomplete", "no successful complete run is recorded"]
    assert blockers(True, 8, 2, (10, 11, 3, 2, 4, 1, 5)) == ["the latest complete run did not process its manifest", "the latest complete run recorded errors", "terminal documents differ from the accepted run", "searchable documents 8 differ from the expected 10"]


def test_company_watchlist(spark):
    frame = spark.createDataFrame
    applications = frame([("NDA", "1", " maker inc "), ("ANDA", "2", "Other"), ("NDA", "3", "MAKER LLC")], "ApplType string, ApplNo string, SponsorName string")
    products = frame([("1", "001", "Zinc", "TABLET;ORAL"), ("1", "002", "Zinc", "TABLET;ORAL"), ("1", "003", "Iron", "GEL"), ("2", "001", "X", "Y"), ("3", "001", "", "Z"), ("3", "002", "Tin", "A;B")], "ApplNo string, ProductNo string, ActiveIngredient string, Form string")
    statuses = frame([("1", "001", "Discontinued"), ("1", "001", "Prescription"), ("1", "003", "None (Tentative Approval)"), ("3", "002", "Unknown")], "ApplNo string, ProductNo string, MarketingStatusDescription string")
    got = sorted((r.normalized_name, r.dosage_form, r.route, r.number, r.ProductNo, r.company_status) for r in corpus.company_watchlist(applications, products, statuses, ["Maker Inc", " maker llc", ""]).collect())
    assert got == [("iron", "GEL", None, "NDA1", "003", "tentative"), ("tin", "A", "B", "NDA3", "002", None), ("zinc", "TABLET", "ORAL", "NDA1", "001", "approved")]
    assert [r.alias for r in corpus.sponsor_aliases(applications, "maker").collect()] == ["MAKER INC", "MAKER LLC"]
