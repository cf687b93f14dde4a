"""op4, op10 and the pipeline as a whole against plain loops over the small tables."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
import tiktoken
from conftest import SF

import corpus_pipeline
from tessera.llm import bpe, mixing, quality
from tessera.llm.registry import QUERIES


def plain_ftrl(rows, epochs, alpha=0.5, beta=1.0, l1=1e-4, l2=1e-4):
    """One coordinate at a time, as the update rule is written."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for y, at, v in rows:
            w = {int(i): weight(int(i)) for i in at}
            p = 1 / (1 + math.exp(-sum(w[int(i)] * float(x) for i, x in zip(at, v))))
            for i, x in zip(map(int, at), map(float, v)):
                g = (p - y) * x
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def sampled(spark):
    """Labelled texts that training may see, in the order of their hashes."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(~quality.is_held_out()).dropna(subset=["quality"])
    rows = labels.selectExpr("doc_id", "quality", "xxhash64(cast(doc_id as string)) as h").orderBy("h", "doc_id", "quality").collect()
    return docs, [(r.quality, docs[r.doc_id]) for r in rows if r.doc_id in docs]


def test_training_and_scores_are_the_plain_ones(spark):
    docs, rows = sampled(spark)
    features = quality.Features()
    plain = plain_ftrl([(y, *features.of((t or "").encode())) for y, t in rows], 3)
    weights = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").filter(~quality.is_held_out()))
    assert np.abs(weights[list(plain)] - np.array(list(plain.values()))).max() < 1e-6 and np.count_nonzero(weights) == sum(w != 0 for w in plain.values())
    for r in QUERIES["op4_quality"](spark, SF).collect():
        at, v = features.of((docs[r.doc_id] or "").encode())
        margin = sum(plain.get(int(i), 0.0) * float(x) for i, x in zip(at, v))
        assert abs(r.score - 1 / (1 + math.exp(-margin))) < 1e-6 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


@pytest.mark.parametrize("labels", [0, 1])
def test_labels_of_one_class_learn_nothing(spark, labels):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    weights = quality.train(docs, spark.createDataFrame([(i, labels) for i in range(9)], "doc_id long, quality int"))
    assert not weights.any() and {r.score for r in quality.score(docs, weights).collect()} == {0.5}


@pytest.fixture(scope="module")
def reference():
    path, pattern = bpe.default_vocabulary()
    ranks = {token: i for i, token in enumerate(bpe.read_ranks(path))}
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def plain_digests(reference, text):
    ids = reference.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_every_document_encodes_as_tiktoken_does(spark, reference):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op10_bpe"](spark, SF).collect()}
    assert got == {i: plain_digests(reference, t) for i, t in docs.items()}


def test_pipeline_is_its_stages(spark, reference, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # quality: exactly the rows that the operator scores 0.5 or more
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    good = {r.doc_id for r in QUERIES["op4_quality"](spark, SF).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == good and 0 < len(good) < docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    # mixing: every row as often as the operator takes it
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(docs).collect()}
    mixed = corpus_pipeline.mixing_stage(spark, docs, SF).collect()
    times = {}
    for r in mixed:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {i: t // n for i, (t, n) in taken.items() if t}
    # tokens of what was mixed, and run() as a whole
    want = sorted((r.doc_id, *plain_digests(reference, r.text)) for r in mixed)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
