"""Differences: applied to the old version they give the new one."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from tessera.operators import patience

SCHEMA = "pair_id long, old array<string>, new array<string>"


def split(pages):
    return [" ".join(raw.split()) for p in pages or [] for raw in (p or "").splitlines() if raw.split()]


def applied(old, changes):
    """The old lines with changes made, matched lines kept."""
    out, at = [], 0
    for h in sorted(changes, key=lambda h: h.hunk):
        out += old[at : h.after]
        assert [x.text for x in h.removed] == old[h.after : h.after + len(h.removed)]
        out += [x.text for x in h.added]
        at = h.after + len(h.removed)
    return out + old[at:]


def check(spark, pairs):
    got = {}
    for h in patience.hunks(spark.createDataFrame(pairs, SCHEMA)).collect():
        got.setdefault(h.pair_id, []).append(h)
    for i, old, new in pairs:
        assert [x.lower() for x in applied(split(old), got.get(i, []))] == [x.lower() for x in split(new)], i
        assert all(h.kind == ("insert" if not h.removed else "delete" if not h.added else "replace") for h in got.get(i, []))
    return got


def test_old_and_changes_give_new(spark):
    r = random.Random(11)
    pairs = []
    for i in range(60):
        old = [r.choice(["Same line", f"line {r.randrange(40)}", "  spaced   out ", "", "ÜBER", "x\x0by"]) for _ in range(r.randrange(30))]
        new = list(old)
        for _ in range(r.randrange(8)):
            at = r.randrange(len(new) + 1)
            new = r.choice([new[:at] + new[at + 1 :], [*new[:at], f"new {r.randrange(9)}", *new[at:]], new[at:] + new[:at], new[:at] + new[at : at + 2] * 2 + new[at + 2 :]])
        cut = r.randrange(len(new) + 1)
        pairs.append((i, ["\n".join(old)], ["\n".join(new[:cut]), None, "\r\n".join(new[cut:])]))
    pairs += [(100, None, ["a\nb"]), (101, ["a\nb"], []), (102, None, None), (103, ["a b"], [" A   B "]), (104, ["x\n" * 500], ["x\n" * 300])]
    got = check(spark, pairs)
    assert 103 not in got and 102 not in got
    assert sum(len(h.removed) for h in got[104]) == 200 and not any(h.added for h in got[104])
    pages = [x.page for i in range(60) for h in got.get(i, []) for x in h.added]
    assert set(pages) <= {1, 3} and 3 in pages


def test_documents(spark):
    from tessera.join_queries import _versions

    check(spark, [tuple(r) for r in _versions(spark, "/root/testdata/sf0.001").collect()])


def test_one_changed_line(spark):
    old = ["Page one.\nKeep.\nDose 10 mg.\nKeep too."]
    new = ["Page one.", "Keep.\nDose 20 mg.\nKeep too."]
    (h,) = patience.hunks(spark.createDataFrame([(1, old, new)], SCHEMA)).collect()
    assert (h.kind, h.after, h.removed[0].page, h.removed[0].text, h.added[0].page, h.added[0].text) == ("replace", 2, 1, "Dose 10 mg.", 2, "Dose 20 mg.")


def test_rising():
    r = random.Random(12)
    for _ in range(200):
        x = r.sample(range(20), r.randrange(9))
        best = max((sum(1 for _ in s) for s in [[x[i] for i in range(len(x)) if m >> i & 1] for m in range(1 << len(x))] if s == sorted(s)), default=0)
        got = [x[i] for i in patience.rising(x)]
        assert got == sorted(got) and len(got) == best


def test_packets_keep_to_their_budgets(spark):
    new = ["\n".join(f"{'é"' * 700} {i}\nkept {i}" for i in range(30))]
    old = ["\n".join(f"kept {i}" for i in range(30))]
    changes = patience.hunks(spark.createDataFrame([(1, old, new), (2, ["a"], ["b\n" + "c " * 3000 + "\nd"])], SCHEMA))
    got = {r.pair_id: json.loads(r.packet)["changes"] for r in patience.packets(changes).collect()}
    sizes = [len(json.dumps(c, ensure_ascii=False, separators=(",", ":"))) for c in got[1]]
    assert sum(sizes) <= patience.DIFF_BUDGET < sum(sizes) + sizes[0] and all(len(c["current"][0]["text"]) == 1200 for c in got[1])
    (one,) = got[2]
    assert [len(x["text"]) for x in one["current"]] == [1, 1200, 1] and one["previous"] == [{"page": 1, "text": "a"}]
    tight = patience.packets(changes, budget=10, side_budget=1000).filter("pair_id = 2").first().packet
    assert [len(x["text"]) for x in json.loads(tight)["changes"][0]["current"]] == [1]


def test_summary(spark):
    rows = [(None, ["a"]), ([], ["a"]), (["A  b\nc"], ["a b", " c "]), (["a"], ["b"]), (["a"], None)]
    df = spark.createDataFrame(rows, "old array<string>, new array<string>").select(patience.change_summary(F.col("old"), F.col("new")).alias("s"))
    assert [r.s for r in df.collect()] == ["initial", "initial", "whitespace_only", "changed", "changed"]
