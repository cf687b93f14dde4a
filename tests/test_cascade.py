"""The whole cascade against the plain loop, and the candidates of its fuzzy stage against all pairs."""

from __future__ import annotations

import random

from conftest import SF
from pyspark.sql import functions as F

from tessera import queries as q
from tessera.functions import names
from tessera.functions.sequential import token_sort_ratio
from tessera.operators import joins


def _fits(a, b):
    a, b = (" ".join((x or "").lower().split()) for x in (a, b))
    return not a or not b or a.startswith(b) or b.startswith(a)


def test_fuzzy_cascade_is_the_plain_loop(spark):
    listings, products = q.misspelt_catalogue(spark, SF)
    keyed = lambda df: df.withColumns({"canon": names.canonical_name(F.col("name")), "strip": names.stripped_name(F.col("name")), "combo": names.is_combination(F.col("name")), "parts": names.component_keys(F.col("name"))}).collect()
    listings, products, want = keyed(listings), keyed(products), {}
    ratio = {}
    for li in listings:
        fit = [p for p in products if _fits(li["route"], p["route"]) and _fits(li["dosage_form"], p["dosage_form"])]
        own = lambda p: [k for k in (p["canon"], p["strip"]) if k]
        found = {p["product_id"]: (1.0, "canonical") if p["canon"] == li["canon"] else (0.92, "stripped") for p in fit if li["canon"] and li["canon"] in own(p)}
        found = found or {p["product_id"]: (0.92, "stripped") for p in fit if li["strip"] and li["strip"] in own(p)}
        if not found and li["combo"]:
            found = {p["product_id"]: (0.8, "combo_component") for p in fit if set(li["parts"]) & set(own(p))}
        if not found and li["strip"]:
            for p in fit:
                for k in own(p):
                    if (li["strip"], k) not in ratio:
                        near = 46 * (len(li["strip"]) + len(k)) <= 100 * min(len(li["strip"]), len(k))
                        ratio[li["strip"], k] = token_sort_ratio(li["strip"], k) if near else 0.0
                best = max(ratio[li["strip"], k] for k in own(p))
                if best >= 92:
                    found[p["product_id"]] = (round(best / 100, 6), "fuzzy")
        want |= {(li["listing_id"], p): v for p, v in found.items()}
    got = q.entity_cascade_fuzzy(spark, SF).collect()
    assert {(r["listing_id"], r["product_id"]): (r["confidence"], r["rationale"]) for r in got} == want and len(got) == len(want)
    assert {v[1] for v in want.values()} >= {"stripped", "combo_component", "fuzzy"}


def test_similar_is_all_pairs(spark):
    rng = random.Random(5)
    right = ["hydroxychloroquine", "dexamethasone", "a", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "b a cccccccccc"] + ["".join(rng.choices("abcde ", k=rng.randint(3, 60))).strip() or "x" for _ in range(150)]
    left = ["ydroxychloroquin", "xdexamethason", "aaaaaaaaaaaaaaaaaaaaaaaaa", "cccccccccc a b"]
    for t in right:
        for _ in range(4):
            s = list(t)
            for _ in range(rng.randint(1, 1 + len(t) // 8)):
                at = rng.randrange(len(s) + 1)
                s[at : at + rng.randint(0, 1)] = rng.choices("abcde ", k=rng.randint(0, 1))
            left.append("".join(s))
    table = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r["left"], r["right"]): r["ratio"] for r in joins.similar(table(left), table(right)).collect()}
    want = {(a, b): r for a in set(left) - {""} for b in set(right) if 46 * abs(len(a) - len(b)) <= 50 * len(a + b) and (r := token_sort_ratio(a, b)) >= 92}
    assert got == want and ("ydroxychloroquin", "hydroxychloroquine") in got and ("xdexamethason", "dexamethasone") in got
