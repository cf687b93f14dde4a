"""Chunks, rebuilt blocks, page tables and diversity on small literal documents."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.functions import sequential
from tessera.plans import chunking, detection

HEADED = "Text before the first header goes on.\nI. Introduction\n" + "This section says enough to stand alone. " * 8 + "\nA. Short\nlittle"


def chunks(spark, pages, strip=False):
    rows = chunking.chunked(spark.createDataFrame([(1, pages)], "doc_id long, pages array<string>"), strip).orderBy("ordinal").collect()
    return [(r["page"], r["section_path"], r["text"]) for r in rows]


def test_sections_merge_and_carry_over_pages(spark):
    got = chunks(spark, [HEADED, "", None, "Next page without header.", "B. Dose\n" + "x " * 200])
    assert [(p, s) for p, s, _ in got] == [(1, "I Introduction"), (4, "A Short"), (5, "B Dose")]
    assert got[0][2].startswith("Text before") and got[0][2].endswith("A. Short\nlittle")  # small parts go on and back
    assert got[1][2] == "Next page without header."
    assert chunks(spark, []) == chunks(spark, ["", " \n"]) == []


def test_windows_overlap_and_cover(spark):
    rng = random.Random(3)
    for body in (" ".join(map(str, range(3000))), "".join(f"{i:06d}" for i in range(2000)), "".join(rng.choice(["alpha ", "beta. ", "gamma: ", "d"]) + str(i) for i in range(3000))):
        parts = chunking.windows(body)
        at = 0
        for p in parts:
            start = body.find(p, max(at - chunking.OVERLAP - chunking.LOOK_BACK, 0))
            assert 0 <= start <= at and len(p) <= chunking.WINDOW
            at = start + len(p)
        assert at == len(body)


def test_furniture_goes(spark):
    pages = [f"Running head {i}\nContains Nonbinding Recommendations\nfact {i} stays\nThis draft guidance, when finalized, will\nrepresent thinking\n\nkept {i} too" for i in range(1, 5)]
    assert chunks(spark, pages, True) == [(i, None, f"fact {i} stays\n\nkept {i} too") for i in range(1, 5)]


def test_blocks_from_chunks(spark):
    rows = [(1, 1, 0, "Guidance on things\nJanuary 2020\nI. Scope\nThe first line of a paragraph that is rather long and goes\non here."), (1, 1, 1, "rather long and goes\non here.\nStrength:\nAnalytes: one"), (1, 2, 2, "12 Jan\ncontinues")]
    got = chunking.rebuilt_documents(spark.createDataFrame(rows, "doc_id long, page int, ordinal int, text string")).first()["blocks"]
    assert [(b["type"], b["page"], b["text"]) for b in got] == [
        ("title", 1, "Guidance on things"), ("meta", 1, "January 2020"), ("h2", 1, "I. Scope"), ("p", 1, "The first line of a paragraph that is rather long and goes on here."),
        ("h2", 1, "Strength:"), ("p", 1, "Analytes: one"), ("meta", 2, "12 Jan continues"),
    ]


def test_page_tables(spark):
    rows, y = [], 0.0
    for cells in (["Table 1 Assay"], ["Test", "Limit", "Result"], ["Assay", "NMT 2.0", "1.5"], ["", "NLT 1", "0.5"], ["plain text"], ["Name:", "Aspirin"], ["Batch number", "12"], ["lone", "pair"]):
        rows += [(1, 1, t, 10.0 * i, y, 10.0 * i + 4, y + 1.0) for i, t in enumerate(cells)]
        y += 1.2
    r = detection.reconstructed(spark.createDataFrame(rows, "doc_id long, page int, text string, x0 double, y0 double, x1 double, y1 double")).first()
    grid, pairs = r["tables"]
    assert (grid["kind"], grid["title"], grid["headers"], grid["rows"]) == ("grid", "Table 1 Assay", ["Test", "Limit", "Result"], [["Assay", "NMT 2.0", "1.5"], ["", "NLT 1", "0.5"]])
    assert (pairs["kind"], pairs["title"], [(p["label"], p["value"]) for p in pairs["pairs"]]) == ("key_value", "plain text", [("Name", "Aspirin"), ("Batch number", "12")])
    assert r["prose"] == ["Table 1 Assay", "plain text", "lone pair"]


def test_mmr_is_the_plain_greedy_choice():
    rng = random.Random(4)
    words = "a b c d e f_g h".split()
    for _ in range(300):
        n, k, w = rng.randint(0, 8), rng.randint(-1, 9), rng.choice([0.2, 0.7, 1.0])
        scores = [rng.choice([None, rng.random(), 0.5]) for _ in range(n)]
        texts = [" ".join(rng.choices(words, k=rng.randint(0, 4))) for _ in range(n)]
        sets = [set(t.replace("_", " ").split()) for t in texts]
        like = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0  # noqa: B023, E731
        left, want = list(range(n)), []
        if k >= n or w >= 1 or k <= 0:
            want = left[: max(k, 0)]
        else:
            while len(want) < k:
                value = lambda i: -1e9 if scores[i] is None else w * scores[i] - (1 - w) * max((like(sets[i], sets[j]) for j in want), default=0.0)  # noqa: B023, E731
                want.append(max(left, key=lambda i: (round(value(i), 12), -i)))  # noqa: B023
                left.remove(want[-1])
        assert sequential.mmr(scores, texts, k, w) == want


def test_detected_is_deduplicated(spark):
    grid = ("grid", "Table 2", 1, None, 3, ["Test", "Limit", "Result"], [["Assay", "NMT 1.0", "2.0"], ["Assay", "NMT 1.0", "2.0"], ["Water", "NMT 1.0", "0.5"]], None)
    docs = spark.createDataFrame([(1, "f", [(1, 800.0, [("AET is 5 ug/g here and AET of 9 ug/g there", "body", 1, 0, None)], [grid])])], detection.DOCUMENT)
    got = detection.detected(docs).select("title", "tier", "source").collect()
    assert sorted(r["source"] for r in got) == ["oracle:cross_reference_aet", "oracle:result_vs_limit"]
    assert {r["title"] for r in got} == {"Result out of specification for Assay", "AET stated with conflicting values across the document"}
