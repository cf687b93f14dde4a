"""Targets of many sources against a plain loop."""

from __future__ import annotations

import random

from tessera.llm import mixing


def filled(sizes: dict[str, int], weights: tuple[int, ...], most: int) -> dict[str, float]:
    """Rounds of sharing by weight: whoever passes most times its size stops there, until nobody does."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes))}
    out, left, open_ = {}, sum(sizes.values()), set(sizes)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        out |= {s: float(most * sizes[s]) for s in full}
        left, open_ = left - sum(most * sizes[s] for s in full), open_ - full
    return out


def test_targets_of_many_sources(spark):
    rng = random.Random(5)
    sizes = {f"a{i:04}": rng.choice([0, 1, 7, 90, 1000, 40000]) for i in range(500)}
    rows = [(s, part) for s, n in sizes.items() for part in (n // 3, n - n // 3)]
    got = {r["skey"]: (r["source_size"], r["target"]) for r in mixing.targets(spark.createDataFrame(rows, "skey string, size long"), (5, 2, 1), 3).collect()}
    want = filled(sizes, (5, 2, 1), 3)
    assert {s: n for s, (n, _) in got.items()} == sizes
    assert all(abs(t - want[s]) < 1e-6 * max(1, want[s]) for s, (_, t) in got.items())


def test_running(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(100)) for i in range(300)]
    got = {r["k"]: (r["n"], r["s"]) for r in mixing.running(spark.createDataFrame(rng.sample(rows, 300), "k long, v long").selectExpr("k", "v", "1 as one").repartition(5), ["k"], {"n": "one", "s": "v"}).collect()}
    assert got == {k: (k, sum(v for _, v in rows[:k])) for k, _ in rows}


def test_repeated_and_null_ids_meet_their_targets(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    rows = [(None, s, "w " * 5) for s in ("a", "b") for _ in range(50)] + [(7, "c", "v " * (1 + i % 3)) for i in range(100)] + [(None, "c", None), (7, None, ""), (8, None, "same words"), (8, None, "same words")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(path)
    got = mixing.mix(spark.read.parquet(path)).collect()
    assert len(got) == len(rows)
    for source in ("a", "b", "c", None):
        mine = [r for r in got if r["source"] == source]
        # less than the smallest row is missing
        assert 0 <= mine[0]["target"] - sum(r["taken"] for r in mine) < max(r["size"] for r in mine)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(spark.read.parquet(path)).collect()))
    taken = sorted((str(r["doc_id"]), str(r["source"]), r["text"]) for r in mixing.mixed_rows(spark.read.parquet(path)).collect())
    assert sum(len(t[2].split()) for t in taken) == sum(r["taken"] for r in got)
