"""Several exchanges of blocks, and bins cut into parts, against one exchange over one chunk."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import lm, packed, substring


@pytest.fixture(scope="module")
def docs(spark):
    shared = [" ".join(f"p{k}w{i}" for i in range(16)) for k in range(5)]
    rows = [(3 * d, " ".join(f"own{d}x{i}" for i in range(d % 7)) + f" {shared[d % 5]} and {shared[d * d % 5]}") for d in range(40)]
    rows += [(None, shared[0]), (None, None), (6, shared[1]), (6, shared[1]), (500, ""), (10**12, shared[2])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


def plain(df):
    return sorted(map(repr, (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())))


def test_widths():
    assert packed.widths(256, 100, 256) == [1]
    assert packed.widths(257, 16, 256) == [256, 1]
    assert packed.widths(9, 28, 3) == [27, 9, 3, 1]


@pytest.mark.parametrize("fan", [2, 5])
def test_substring(spark, docs, fan):
    want = plain(substring.dedup(docs))
    assert any("own" in r for r in want) and any(", 0," not in r for r in want)
    assert plain(substring.dedup(docs, chunk_bytes=300, fan=fan)) == want


def test_substring_index(docs, tmp_path):
    want = plain(substring.dedup(docs))
    got = []
    for batch, part in enumerate(("doc_id < 30", "doc_id >= 30 and doc_id < 60", "doc_id >= 60 or doc_id is null")):
        got += plain(substring.dedup(docs.filter(part), index=str(tmp_path / "index"), batch=batch, chunk_bytes=300, fan=3, fanout=2))
    assert sorted(got) == want


def test_bins_in_parts(docs, monkeypatch):
    want = plain(substring.dedup(docs))
    monkeypatch.setattr(packed, "CUT_POINTS", 3)
    of, chunks, _ = packed.in_order(docs, 300)
    ids = np.array(sorted({3 * d for d in range(40)} | {500, 10**12, packed.NULL_ID}), np.int64)
    assert chunks > 6 and (np.diff(of(ids)) >= 0).all() and 0 <= of(ids).min() and of(ids).max() < chunks
    assert plain(substring.dedup(docs, chunk_bytes=300, fan=2)) == want


@pytest.mark.parametrize("fan", [2, 5])
def test_lm(docs, fan):
    assert plain(lm.score(docs, chunk_bytes=300, fan=fan)) == plain(lm.score(docs))


@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 2)), min_size=1, max_size=8, unique=True), min_size=1, max_size=5))
@settings(deadline=None)
def test_merged(blocks):
    """Equal fingerprints with different checks are different windows."""
    blocks = [sorted(b, key=lambda e: e[0]) for b in blocks]
    keys = [np.array([k for k, _ in b], np.uint64) for b in blocks]
    m = substring._Merged(pa.table({"bucket": [0] * len(blocks), "chunk": list(range(len(blocks))), "keys": [packed.put(k) for k in keys], "checks": [bytes(c for _, c in b) for b in blocks]}))
    flat = [e for b in blocks for e in b]
    distinct = list(zip(*(x.tolist() for x in m.distinct())))
    assert sorted(distinct) == sorted(set(flat))
    assert [distinct[p] for p in m.place()] == [flat[i] for i in m.order]
    known = set()
    for (*_, raw, _), b in zip(m.answers(), blocks):
        assert np.unpackbits(np.frombuffer(raw, np.uint8), count=len(b)).astype(bool).tolist() == [e in known for e in b]
        known |= set(b)
@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_is_the_plain_model(spark, docs, order):
    """Document by document, against counts of word tuples."""
    from collections import Counter
    from math import log

    rows = docs.collect() + [("x", "a a a b")]
    rows = [(i, (r[1] or "").split()) for i, r in enumerate(rows)]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"), order=order, chunk_bytes=700).collect()}
    count = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    everything = sum((count(w) for _, w in rows), Counter())
    total = sum(len(w) for _, w in rows)
    for i, w in rows:
        own, others, want = count(w), max(total - len(w), 1), 0.0
        for at in range(len(w)):
            most = min(at + 1, order)
            for n in range(most, 0, -1):
                gram = tuple(w[at - n + 1 : at + 1])
                if num := everything[gram] - own[gram]:
                    want += log(num / (everything[gram[:-1]] - own[gram[:-1]] if n > 1 else others) * lm.ALPHA ** (most - n))
                    break
            else:
                want += log(lm.ALPHA**most / others)
        assert got[i]["n_words"] == len(w) and abs(got[i]["log_score"] - want) < 1e-9


def test_lm_works_on_a_chunk_at_once(monkeypatch):
    """Hashing and counting n-grams took calls for each document."""
    calls = []
    monkeypatch.setattr(lm, "_grams", lambda words, order, grams=lm._grams: (calls.append(order), grams(words, order))[1])
    texts = ["a b c", "", "d", "a b a b", "c"]
    blob = zstandard.ZstdCompressor().compress(pickle.dumps((np.arange(5), [t.encode() for t in texts]), 5))
    ids, lengths, by_order, places = lm._exploded(pa.table({"blob": [blob]}), 2)
    assert calls == [1, 2] and lengths.tolist() == [3, 0, 1, 4, 1] and ids.tolist() == list(range(5))
    want = [lm._HASHES.hashes(t.encode().split()) for t in texts]
    for n in (1, 2):
        assert by_order[n - 1].tolist() == [g for w in want for g in (w if n == 1 else lm.grams(w, n, 7)).tolist()]
    assert places[1].tolist() == [0, 1, 4, 5, 6]
