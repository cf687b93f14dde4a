"""VARIANT columns, prompt schemas, sentences and overlaps against plain definitions."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from tessera.functions import registered, sequential, text, variants
from tessera.functions.sequential import without_overlap
from tessera.plans import answers, corpus


def test_paths_types_and_faults(spark):
    rows = ['{"a": 1, "b": "x", "c": [1], "d": {"e": null}, "f": 1.5, "g": true}', "not json", None, "[1]", '{"a": "1"}', "{}"]
    df = spark.createDataFrame([(r,) for r in rows], "j string").withColumn("v", variants.parsed(F.col("j")))
    required = {"a": "number", "b": "string", "c": "array", "d": "object", "f": "number", "g": "boolean"}
    got = df.select(variants.at(F.col("v"), "$.a", "int").alias("a"), variants.kind_at(F.col("v"), "$.d.e").alias("k"), variants.is_object(F.col("v")).alias("o"), variants.faults(F.col("v"), required, {"z": "string"}).alias("f")).collect()
    assert [r.a for r in got] == [1, None, None, None, 1, None]
    assert got[0].k == "VOID" and [r.o for r in got] == [True, False, False, False, True, True]
    assert [r.f for r in got[:4]] == [[], ["not_json"], ["not_json"], ["not_object"]]
    assert got[4].f == ["type:a", "missing:b", "missing:c", "missing:d", "missing:f", "missing:g"] and len(got[5].f) == 6


def test_unpivoted_objects(spark):
    rows = [(1, '{"x": "one", "y": " ", "n": 5, "z": null, "o": {"k": 1}}'), (2, "broken"), (3, None), (4, "[]"), (5, "{}")]
    labels = spark.createDataFrame([(k, k.upper()) for k in "xynzo"], "field string, label string")
    got = corpus.unpivoted(spark.createDataFrame(rows, "doc_id long, fields_json string"), labels)
    assert sorted((r.doc_id, r.field, r.label, r.value) for r in got.collect()) == [(1, "n", "N", "5"), (1, "o", "O", '{"k":1}'), (1, "x", "X", "one")]


def test_observations_and_prompts(spark):
    log = [(1, 10, json.dumps({"route_call": {"outcome": "success", "mode": "m", "latency_ms": 12, "cost_usd": 0.5}})), (2, 11, json.dumps({"route_call": None})), (3, 12, "{"), (4, 13, json.dumps({"route_call": {"outcome": "invalid", "latency_ms": "slow"}})), (5, 9, None)]
    got = answers.observations(spark.createDataFrame(log, "id long, created_at long, route_json string")).collect()
    assert [tuple(r) for r in got] == [(4, 13, "invalid", None, None, None), (1, 10, "success", "m", 12.0, 0.5)]
    lines = [(1, '{"case_id": "a", "question": "q", "expected_terms": ["x"]}'), (2, '{"case_id": 5}'), (3, "#"), (4, '{"case_id": "b", "question": "q", "expected_modes": "m"}')]
    good, bad = answers.prompt_cases(spark.createDataFrame(lines, "line_no int, value string"))
    assert [(r.case_id, r.expected_terms, r.expected_modes) for r in good.collect()] == [("a", ["x"], None)]
    assert {r.line_no: r.faults for r in bad.collect()} == {2: ["type:case_id", "missing:question"], 3: ["not_json"], 4: ["type:expected_modes"]}


SENTENCES = {
    None: [], "": [], "  ": [], "One. Two!  Three?": ["One.", "Two!", "Three?"], "See Fig. 2 here. Next.": ["See Fig. 2 here.", "Next."], "As in Ph. Eur. 5.1 so. At this pH. Then.": ["As in Ph. Eur.", "5.1 so.", "At this pH.", "Then."],
    "e.g. this vs. that. End": ["e.g. this vs. that.", "End"], "no. 5 and\nDr. No. It is. Good ": ["no. 5 and\nDr. No. It is.", "Good "], "a.b. c": ["a.b. c"],
}


def test_sentences(spark):
    registered.register(spark)
    df = spark.createDataFrame([(t,) for t in SENTENCES], "t string").select("t", text.sentences(F.col("t")).alias("s"), F.expr("split_sentences(t)").alias("q"))
    got = {r.t: (r.s, r.q) for r in df.collect()}
    assert all(sequential.sentences(t or "") == s for t, s in SENTENCES.items())
    assert {t: s for t, (s, _) in got.items()} == SENTENCES and all(s == q for s, q in got.values())


def test_overlaps_are_the_longest():
    r = random.Random(31)
    for _ in range(3000):
        a, b = ("".join(r.choice("ab") for _ in range(r.randrange(14))) for _ in range(2))
        least, most = r.randrange(1, 5), r.randrange(5, 12)
        n = max((n for n in range(least, min(len(a), len(b), most) + 1) if a.endswith(b[:n])), default=0)
        assert without_overlap(a, b, least, most) == b[n:]
    assert without_overlap("x" * 10**5, "x" * 10**5, 24, 1200) == "x" * (10**5 - 1200)
