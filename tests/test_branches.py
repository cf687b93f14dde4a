"""Every branch of small operators that no query with SQL reaches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import names, text
from tessera.functions.sequential import visible_text
from tessera.operators import joins, ranking, sets
from tessera.plans import detection


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + ", ".join(f"c{k} {kind}" for k in range(len(values[0]) if isinstance(values[0], tuple) else 1)))
    return [r[0] for r in df.orderBy("i").select(f(*(F.col(c) for c in df.columns[1:]))).collect()]


def test_names(spark):
    assert column(spark, [("Zincor", " zincor "), ("Zinc HCl", "zinc"), ("Zinc Sulfate", "ZINCOR"), ("Iron XR tablets", "iron xr"), ("abc", "xabcx"), ("Long name", "")], names.verifies_name) == [True, True, False, True, False, False]
    with pytest.raises(Exception, match="too short"):
        column(spark, [("ab", "ab")], names.verifies_name)
    assert column(spark, [("A-b c!", "xx ab c"), ("abcd", "ab"), ("wxyz", "the wxyz of"), ("", "x")], names.contains_either_way) == [False, False, True, False]
    assert column(spark, ["Zinc tablets [ Maker  Inc ]", "No labeler", "[a] in front", None], names.labeler) == ["Maker Inc", None, None, None]
    assert column(spark, ["a b/c", "__", None, "ok-1.x"], names.file_stem) == ["a_b_c", "psg", "psg", "ok-1.x"]


def test_markers_and_trailers(spark):
    assert column(spark, ["x. [1]", "x! [1, 2][3] y", "x [1]. y", "no"], text.marked_before_stop) == ["x [1].", "x [1, 2][3]! y", "x [1]. y", "no"]
    assert column(spark, ["a [1] b [3, 2] c [9] [1]", "none", "[0]"], lambda c: text.marker_numbers(c, F.lit(3)), "string") == [[0, 2, 1], [], []]
    assert column(spark, ["Answer.\n\nSources:\n[PSG_1, p.2]", "No trailer"], lambda c: F.trim(F.regexp_replace(text.without_trailer(c), r"\s+$", ""))) == ["Answer.", "No trailer"]


PAGES = {
    "<html><body><nav>menu</nav><main><h1>T</h1><script>x()</script><p>a <b>b</b><br>c</p></main><footer>f</footer></body></html>": "T\na b\nc",
    "<body><style>s</style><div role='main'>one<p>two</div>rest</body>": "one\ntwo",
    "<body><article>in</article>out</body>": "in",
    "plain &amp; text": "plain & text",
    "<body><form>no</form>  spaced \n\n out <svg>v</svg></body>": "spaced\nout",
    "": "",
}


def test_visible_text():
    assert {p: visible_text(p) for p in PAGES} == PAGES


def test_latest_rows(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    rows = spark.createDataFrame([(1, 5, None, "a"), (1, 4, 9, "b"), (1, 6, 9, "c"), (2, 1, None, "d")], "doc_id long, version_id long, captured_at long, s string")
    got = sorted((r.doc_id, r.s) for r in joins.with_latest(left, rows, "doc_id", "captured_at", "version_id").collect() if r.s)
    assert got == [(1, "c"), (2, "d")] and joins.with_latest(left, rows, "doc_id", "captured_at").count() == 3


def test_listings_and_findings(spark):
    rows = [(1, 0, "Zinc tab [Maker]", "Jan 2, 2024"), (1, 1, "Zincor tab [Other]", "Jan 1, 2024"), (1, 2, "Zincor tab [Other]", "Feb 1, 2024"), (2, 0, "a [Maker Inc]", "bad"), (2, 1, "b [Maker Inc]", "Jan 5, 2023"), (2, 2, "c", "Jan 5, 2024"), (3, 0, "x", "?"), (3, 1, "y", None)]
    got = {r.g: r.position for r in ranking.preferred_listing(spark.createDataFrame(rows, "g int, position int, title string, published string"), "g", ["Zincor"], ["Maker Inc"]).collect()}
    assert got == {1: 2, 2: 1, 3: 0}
    findings = [(0, "advisory", "high", 0.9), (1, "verified", "low", 0.9), (2, "verified", "high", 0.5), (3, "verified", "high", 0.8), (4, "verified", "high", 0.8)]
    assert [r.position for r in ranking.sorted_findings(spark.createDataFrame(findings, "position int, tier string, severity string, confidence double")).collect()] == [3, 4, 2, 1, 0]


def test_pinned_forms(spark):
    questions = spark.createDataFrame([(1, "What is the study for extended release tablets?"), (2, "oral products"), (3, "tablet or capsule"), (4, "nothing"), (5, "topical gel")], "question_id int, question string")
    combos = [("Tablet", "Oral"), ("Extended Release Tablets", "Oral"), ("Capsule", "Oral"), ("Gel", "Topical")]
    df = spark.createDataFrame([(q, *c) for q in range(1, 6) for c in combos], "question_id int, dosage_form string, route string")
    assert {r.question_id: r.dosage_form for r in ranking.pinned_form(questions, df).collect()} == {1: "Extended Release Tablets", 5: "Gel"}


def test_watchlists_merge_by_trust(spark):
    schema = "active_ingredient string, normalized_name string, dosage_form string, route string, rld_name string, rld_application_number string, company_status string, source string, source_url string"
    current = spark.createDataFrame([("Z", "zinc", "TABLET", "ORAL", "Zincor", "NDA1", "approved", "drugsfda", None), ("I", "iron", "GEL", None, None, "NDA2", None, "manual", "u")], schema)
    incoming = spark.createDataFrame(
        [("Z", "zinc", "tablet ", "oral", "Other", "NDA1", "", "orange_book", "new"), ("I", "iron", "gel", None, "Fe", "NDA2", "approved", "drugsfda", "v"), ("T", "tin", "X", "Y", None, "NDA3", None, "manual", None), ("U", "u", "X", "Y", None, "NDA4", None, "somewhere", None)],
        schema,
    )
    got = {r.normalized_name: r for r in sets.merged_watchlist(current, incoming).collect()}
    assert set(got) == {"zinc", "iron", "tin"} and [got[n].added for n in ("zinc", "iron", "tin")] == [False, False, True]
    assert (got["zinc"].rld_name, got["zinc"].company_status, got["zinc"].source, got["zinc"].source_url) == ("Zincor", "approved", "drugsfda", "new")  # only blanks are filled
    assert (got["iron"].rld_name, got["iron"].company_status, got["iron"].source, got["iron"].source_url) == ("Fe", "approved", "manual", "u")
    over = sets.merged_watchlist(current, incoming.limit(1).withColumn("source", F.lit("manual"))).filter("normalized_name = 'zinc'").first()
    assert (over.rld_name, over.company_status, over.source) == ("Other", "approved", "manual")


def test_domains_and_types(spark):
    assert column(spark, ["Linearity and LOQ of related compounds", "Nothing known", "stability, stability"], detection.domains) == [["method-validation", "impurities"], ["specification", "method-validation", "impurities"], ["stability"]]
    picked = spark.createDataFrame([(["development", "unknown", "development"],), (["unknown"],), (None,)], "p array<string>")
    assert [r[0] for r in picked.select(detection.domains(F.lit("q3d"), F.col("p"))).collect()][:2] == [["development"], ["elemental-impurities"]]
    assert column(spark, [" Specification/COA", "BE", "whatever", None], detection.normal_type) == ["specification", "dissolution", "", ""]


def test_sections_of_findings(spark):
    findings = spark.createDataFrame([(1, 10, "see Table 3", None), (1, 11, None, "Stability"), (1, 12, "Table 9", ""), (2, 13, "Table 3", "x")], "doc_id int, finding_id int, table_ref string, section string")
    sections = spark.createDataFrame([(1, 100, "Results of stability studies", ["Table 3. Limits", "Other"]), (1, 101, "", ["table 4"]), (2, 200, "Specification", None)], "doc_id int, section_id int, heading string, tables array<string>")
    got = sorted((r.finding_id, r.section_id) for r in detection.sections_of_finding(findings, sections).collect())
    assert got == [(10, 100), (11, 100)]


def test_headings(spark):
    blocks = [(1, 0, 1, "1. Scope", 1), (1, 1, 2, "2.1 Methods of test", 1), (1, 2, 2, "2.1 again", 1), (1, 3, 3, "99. No", 1), (2, 0, 1, "1. Alone", 1), (2, 1, 1, "3.5 %", 1), (2, 2, 1, "2 lower", 1), (2, 3, 1, "4. Long " + "x" * 200, 1), (2, 4, 1, "5. Title Here", 3)]
    toc = [(1, "1", "The Scope", 1), (1, "2.1", "Methods", 2), (2, "1", "Only one", 1)]
    got = detection.headings(spark.createDataFrame(blocks, "doc_id int, position int, page int, text string, n_lines int"), spark.createDataFrame(toc, "doc_id int, number string, title string, page int"))
    assert sorted((r.doc_id, r.position, r.number, r.title) for r in got.collect()) == [(1, 0, "1", "The Scope"), (1, 1, "2.1", "Methods"), (2, 0, "1", "Alone")]
