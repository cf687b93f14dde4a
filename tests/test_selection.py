"""Order statistics by refinement against sorted lists."""

from __future__ import annotations

import math
import random
from decimal import Decimal

import pytest

from tessera.operators import aggregates, selection

RANKS = {"p95": selection.nearest_rank(0.95), "r": selection.rounded_index(0.5), "t": selection.truncated_index(0.9), **selection.MIDDLE}


def plain(values):
    v = sorted(values, key=lambda x: (math.isnan(x), x) if isinstance(x, float) else (False, x))
    n = len(v)
    return {"p95": v[max(math.ceil(n * 0.95) - 1, 0)], "r": v[round(0.5 * (n - 1))], "t": v[int(0.9 * (n - 1))], "below": v[(n - 1) // 2], "above": v[n // 2]}


@pytest.mark.parametrize("buckets", [2, 1024])
@pytest.mark.parametrize("kind", ["double", "long", "decimal(20,4)"])
def test_like_sorted_lists(spark, monkeypatch, buckets, kind):
    monkeypatch.setattr(selection, "BUCKETS", buckets)
    r = random.Random(9)
    make = {
        "double": lambda: r.choice([r.gauss(0, 1), r.expovariate(1) * 10 ** r.randrange(-300, 300), float("inf"), -float("inf"), float("nan"), 5.0, -0.5]),
        "long": lambda: r.choice([r.randrange(100), 2**62 + r.randrange(3), -(2**62), 7]),
        "decimal(20,4)": lambda: Decimal(r.randrange(10**6)) / 10000,
    }[kind]
    rows = [(r.choice(["a", "b", None]), r.randrange(3), make()) for _ in range(400)] + [("one", 1, make()), ("none", 1, None), ("a", 0, None)]
    df = spark.createDataFrame(rows, f"g string, h int, v {kind}").repartition(3)
    got = {(x.g, x.h): x for x in selection.order_statistics(df, "v", ["g", "h"], RANKS).collect()}
    groups = {}
    for g, h, v in rows:
        if v is not None:
            groups.setdefault((g, h), []).append(v)
    assert set(got) == set(groups)
    for key, values in groups.items():
        for name, want in plain(values).items():
            assert str(got[key][name]) == str(want) or got[key][name] == want


def test_no_keys_and_no_rows(spark):
    df = spark.createDataFrame([(x,) for x in (3.0, 1.0, 2.0)], "v double")
    assert selection.order_statistics(df, "v", [], selection.MIDDLE).collect() == [(2.0, 2.0)]
    assert selection.order_statistics(df.filter("v > 9"), "v", [], selection.MIDDLE).count() == 0
    got = aggregates.distribution(df.filter("v > 9"), "v").first()
    assert (got.n, got["median"]) == (0, None)


def test_nothing_is_gathered(spark):
    df = spark.createDataFrame([(k % 3, float(k)) for k in range(100)], "g int, v double")
    plan = aggregates.distribution(df, "v", "g")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "percentile" not in plan and "median(" not in plan
