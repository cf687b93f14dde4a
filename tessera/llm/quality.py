"""Quality classification: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Features are word 1- and 2-grams of the surface words, and 1- to 3-grams of word shapes (case, trailing
punctuation, length, "same word as before"), hashed into a fixed space; a text's counts are damped and scaled to
length 1. Training is sequential (FTRL-proximal) over a bounded sample of labelled rows, on the driver; scoring
is a sparse dot product with the broadcast weights, whose size is fixed.

Defined results: null and empty texts have no features and score as the bias alone; null labels aren't used;
without labels of both classes all weights stay 0 and every score is 0.5; repeated rows are scored each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read
from .words import WordHash, grams, mix64, portions, texts

#: Weights: 2^18, of which the last is the bias.
DIMENSIONS = 1 << 18
#: The bound of the training sample (rows). It doesn't grow with the input.
SAMPLE_ROWS = 4_000


def _shape(word: bytes) -> int:
    text = word.decode("utf-8", "replace")
    core = text.strip(".,;:!?()'\"")
    case = "d" if core.isdigit() else "l" if core.islower() else "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "s" if not any(map(str.isalnum, core)) else "m"
    odd = "".join(sorted({c for c in text if not c.isalnum()}))[:4]
    return xxhash.xxh3_64_intdigest(f"{case}{odd}{min(len(core), 24) // 6}{text[-2:] if not text[-1:].isalnum() else ''}".encode())


class Features:
    def __init__(self):
        self.word, self.shape = WordHash(), WordHash(_shape)

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values of a text's features."""
        words = text.split()
        if not words:
            return np.array([DIMENSIONS - 1]), np.array([1.0])
        x, s = self.word.hashes(words), self.shape.hashes(words)
        same = np.zeros(len(x), np.uint64)
        same[1:] = x[1:] == x[:-1]
        s = mix64(s + same)
        all_grams = np.concatenate([grams(x, 1, 1), grams(x, 2, 1), grams(s, 1, 2), grams(s, 2, 2), grams(s, 3, 2)])
        at, count = np.unique(all_grams % np.uint64(DIMENSIONS - 1), return_counts=True)
        value = np.log1p(count)
        return np.append(at.astype(np.int64), DIMENSIONS - 1), np.append(value / np.sqrt((value**2).sum()), 1.0)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> np.ndarray:
    """Weights after FTRL-proximal updates over (label, indices, values), in the order given."""
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    solve = lambda z, n: np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    if len({y for y, *_ in rows}) == 2:
        for _ in range(epochs):
            for y, at, v in rows:
                zi, ni = z[at], n[at]
                w = solve(zi, ni)
                g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
                z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
                n[at] = ni + g * g
    return solve(z, n)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights learned from at most sample_rows of labels (doc_id, label), those of the smallest hashes."""
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id"), F.col("y")]
    some = labels.select("doc_id", F.col(label).cast("int").alias("y")).dropna().orderBy(*order).limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            at, v = zip(*map(features.of, texts(batch["text"]))) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pa.array([a.astype(np.int32).tobytes() for a in at], pa.binary()), pa.array([b.astype(np.float32).tobytes() for b in v], pa.binary())], names=["doc_id", "y", "at", "v"])

    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select(F.col("doc_id").cast("long"), "text", "y").mapInArrow(run, "doc_id long, y int, at binary, v binary")
    got = rows.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "y", "at").limit(sample_rows).collect()
    return ftrl([(r.y, np.frombuffer(r.at, np.int32), np.frombuffer(r.v, np.float32)) for r in got])


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with a column score, the probability of label 1; all columns of docs stay, but for an earlier score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    docs = docs.drop("score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(), shared.value
        for batch in batches:
            for start, body in portions(batch.column(names.index("text"))):
                margin = np.array([w[at] @ v for at, v in map(features.of, body)])
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(body)).columns, pa.array(1 / (1 + np.exp(-margin)), pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def is_held_out(doc_id=None):
    """Rows that training must not see: crc32(doc_id as text) mod 3 = 1."""
    return (F.crc32((doc_id if doc_id is not None else F.col("doc_id")).cast("string")) % 3) == 1


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, read(spark, sf_dir, "labels").filter(~is_held_out()), "quality")
    kept = F.coalesce(is_held_out(), F.lit(False)).alias("held_out")
    return score(docs, weights).select("doc_id", kept, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
