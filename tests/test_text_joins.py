"""Containment and spelling joins against all pairs."""

from __future__ import annotations

import random

import pytest

from tessera.functions.sequential import indel_ratio
from tessera.operators import containment, joins, spelling


def no_nested_loop(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "NestedLoop" not in plan and "Cartesian" not in plan


def test_contained_is_all_pairs(spark):
    r = random.Random(7)
    letters = "abcé 🙂"
    texts = [(i, "".join(r.choice(letters) for _ in range(r.randrange(80)))) for i in range(120)] + [(500, None), (501, ""), (502, "x" * 100_000 + "needle")]
    needles = ["".join(r.choice(letters) for _ in range(r.randrange(1, 10))) for _ in range(150)] + ["", None, "needle", "xxxxxxx", "absent!", texts[3][1], texts[3][1]]
    df = containment.contained(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame(texts, "text_id long, text string").repartition(3))
    assert no_nested_loop(df)
    got = [tuple(x) for x in df.collect()]
    want = {(n, i) for n in needles for i, t in texts if n and t is not None and n in t}
    assert len(got) == len(want) and set(got) == want
    nothing = spark.createDataFrame([], "needle string")
    assert containment.contained(nothing, spark.createDataFrame(texts, "text_id long, text string")).count() == 0


@pytest.mark.parametrize("ratio", [82.0, 90.0, 100.0])
def test_alike_is_all_pairs(spark, ratio):
    r = random.Random(8)
    tokens = ["".join(r.choice("abcd") for _ in range(n)) for n in [*range(1, 30), *range(5, 20)] for _ in range(3)]

    def bent(w):
        for _ in range(r.randrange(1 + len(w) // 4)):
            at = r.randrange(len(w) + 1)
            w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abcd") + w[at:]])
        return w

    words = [bent(t) for t in tokens for _ in range(3)] + ["", None, "a", "zzzz"]
    df = spelling.alike(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in [*tokens, None, ""]], "token string"), ratio)
    assert no_nested_loop(df)
    want = {(w, t) for w in words for t in tokens if w and indel_ratio(w, t) >= ratio}
    got = [(x.word, x.token) for x in df.collect()]
    assert len(got) == len(want) and set(got) == want and (ratio > 99 or len(want) > 100)


def test_external_names_contain_words(spark):
    q = spark.createDataFrame([(1, "Is Metformin covered?"), (2, "none of it")], "question_id long, question string")
    e = spark.createDataFrame([("Metformina XR",), ("Zymetformin",), ("Other",)], "name string")
    own = spark.createDataFrame([("zymetformin",)], "name string")
    got = {(x.question_id, x.name, x.covered) for x in joins.named_elsewhere(q, e, own).collect()}
    assert got == {(1, "Metformina XR", False), (1, "Zymetformin", True)}
