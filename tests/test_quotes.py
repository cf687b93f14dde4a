"""The seed index against the plain match of every pair."""

from __future__ import annotations

import random

from tessera.functions.sequential import edits, match_form, nearest_window, quote_match
from tessera.operators import grams, quotes

WORDS = "the fasting fed study dose 24 900 mL not without healthy subjects in vivo release dissolution ﬁeld “quoted” Ünder pro- tablets".split()


def texts(r, n, least, most):
    return [" ".join(r.choice(WORDS) for _ in range(r.randrange(least, most))) for _ in range(n)]


def bent(r, text):
    """text with up to four edits at any place."""
    for _ in range(r.randrange(5)):
        at = r.randrange(len(text) + 1)
        text = r.choice([text[:at] + text[at + 1 :], text[:at] + r.choice("x 7") + text[at:], text[:at] + r.choice("yz ") + text[at + 1 :]])
    return text


def test_seed_index_finds_what_all_pairs_find(spark):
    r = random.Random(3)
    asked = texts(r, 60, 1, 25) + ["", " ", "a", "mL", "not", "24"] + [None]
    pages = []
    for k in range(50):
        part = [bent(r, q) for q in r.sample([q for q in asked if q], 4)]
        pages.append((k, "\n".join([*texts(r, 1, 0, 30), *part, *texts(r, 1, 0, 30)])))
    pages += [(90, None), (91, ""), (92, "x"), (93, pages[0][1])]
    want = {}
    for i, q in enumerate(asked):
        for k, t in pages:
            found, exact, distance = quote_match(q, t)
            if found:
                want[i, k] = (exact, distance)
    assert sum(not exact for exact, _ in want.values()) > 20
    q = spark.createDataFrame(list(enumerate(asked)), "quote_id long, quote string").union(spark.createDataFrame([(1000, asked[0])]))
    p = spark.createDataFrame(pages, "page_id long, text string").repartition(3)
    got = {(x.quote_id, x.page_id): (x.exact, x.distance) for x in quotes.quote_pairs(q, p).collect()}
    assert got == want | {(1000, k): v for (i, k), v in want.items() if i == 0}


def test_guards():
    page = "Conduct a fasting study in 24 healthy males, and not in females, with dissolution in 900 mL of water."
    cases = {
        "a fastng study in 24 healthy males": (True, False, 1), "conducta fasting study in 24 helthy": (True, False, 2), "a fasting study in 25 healthy males": (False, False, -1),
        "males, and now in females, with": (False, False, -1), "a fxstxng study in 24 healthy males, and": (False, False, -1), "fasting study in 24 very healthy males": (False, False, -1), "fastng": (False, False, -1),
    }
    assert {q: quote_match(q, page) for q in cases} == cases


def test_nearest_window_is_the_least_edit_distance():
    r = random.Random(4)
    for _ in range(60):
        a, b = ("".join(r.choice("ab ") for _ in range(r.randrange(1, n))) for n in (7, 12))
        distance, i, j = nearest_window(a, b)
        assert distance == min(edits(a, b[x:y]) for x in range(len(b) + 1) for y in range(x, len(b) + 1)) == edits(a, b[i:j])


def test_hashes_tell_windows_apart():
    codes = grams.codes_of(match_form("abcabcabd" * 50))
    for width in (1, 3, 9):
        h, want = grams.window_hashes(codes, width), ["".join(map(chr, codes[i : i + width])) for i in range(len(codes) - width + 1)]
        assert len(set(zip(h.tolist(), want))) == len(set(want)) == len(set(h.tolist()))


def test_query_without_a_nested_loop(spark):
    from tessera.join_queries import quote_match_fuzzy

    df = quote_match_fuzzy(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = df.collect()
    assert {r.form for r in rows if r.exact} >= {"as_is"} and not any(r.form == "negated" and r.exact for r in rows)
