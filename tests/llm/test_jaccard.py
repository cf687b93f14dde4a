"""Words whose hashes agree in their upper 40 bits are still two members of a set."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.llm import jaccard
from tessera.llm.packed import get, get_small
from tessera.llm.words import portions


def test_members_are_full_hashes(spark):
    words = [f"w{i}" for i in range(4_000_000)]
    key = np.concatenate([jaccard.grams(jaccard._HASHES.hashes([w.encode() for w in words[i : i + 10_000]]), 1) for i in range(0, len(words), 10_000)])
    order = np.argsort(key)
    near = np.flatnonzero(np.diff(key[order] >> np.uint64(24)) == 0)
    assert len(near) > 0
    x, y = (words[i] for i in order[near[0] : near[0] + 2])
    same = f"{x} {y} " + " ".join(f"other{i}" for i in range(7))
    docs = spark.createDataFrame([(1, same), (2, same + " more")], "doc_id long, text string")  # 9 of 10
    got = {r["doc_id"]: r["component_id"] for r in jaccard.groups(docs, jaccard.Join(words=1, num=90, den=100)).collect()}
    assert got == {1: 1, 2: 1}


def _batch(texts):
    ids = pa.array(range(len(texts)), pa.int64())
    return pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), ids], names=["doc_id", "text", "root"])


def test_portions_hold_every_text():
    texts = [None, "", "a b", "x" * 5000, None, *["word " * 20] * 50, "y" * 3000, ""]
    parts = list(portions(pa.array(texts, pa.string()), 1000))
    assert [t for _, body in parts for t in body] == [(t or "").encode() for t in texts]
    assert [at for at, _ in parts] == np.cumsum([0, *(len(body) for _, body in parts[:-1])]).tolist()
    assert all(sum(map(len, body)) - max(map(len, body)) <= 1000 for _, body in parts)
    assert list(portions(pa.array([], pa.string()))) == []


def test_a_batch_is_listed_in_little_memory():
    """A batch of whole texts at once took 89 MB here, besides the batch."""
    rng = np.random.default_rng(1)
    words = np.array([f"{c}{i}" for c in "abcdefghij" for i in range(5000)])
    batch = _batch([" ".join(words[rng.integers(0, len(words), 330)]) for _ in range(6000)])
    join = jaccard.Join(words=5, num=80, den=100)
    list(jaccard.listed(batch.slice(0, 100), join, 16))
    tracemalloc.start()
    try:
        for _ in jaccard.listed(batch, join, 16):
            pass
        assert tracemalloc.get_traced_memory()[1] < 64e6
    finally:
        tracemalloc.stop()


def test_blocks_hold_every_signature(monkeypatch):
    texts = [f"{i % 7} of these few words and {i} others " * (1 + i % 30) for i in range(400)] + [None, "", "one"]
    batch, join = _batch(texts), jaccard.Join(words=5, num=80, den=100)
    sig, who = jaccard.signatures([jaccard.shingles((t or "").encode(), 5) for t in texts], join)
    monkeypatch.setattr(jaccard, "SENT", 1000)
    monkeypatch.setattr(jaccard, "portions", lambda column: portions(column, 4000))
    got = []
    for out in jaccard.listed(batch, join, 16):
        for keys, ids in zip(out["keys"].to_pylist(), out["ids"].to_pylist()):
            keys = get(keys)
            got += zip(keys.tolist(), get_small(ids, len(keys)).tolist())
    assert sorted(got) == sorted(zip(sig.tolist(), who.tolist()))


def test_batches_are_small_while_groups_run(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    monkeypatch.setattr(jaccard, "cut", lambda df, cut=jaccard.cut: (seen.append(spark.conf.get(key)), cut(df))[1])
    same = "these are some words that two documents share and no other does"
    docs = spark.createDataFrame([(1, same), (2, same), (3, "else")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.groups(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert set(seen) == {"1000"} and spark.conf.get(key) == before
