"""A training corpus from documents: quality, near-duplicates, secrets, mix, tokens.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents, extra ones included, whatever
their names. Null and empty texts: score by the bias alone, link with nothing, hold no secrets, have size 0 and so end at
the mix. Null ids stay in every stage (as near-duplicates of nothing). Repeated rows are judged each, and stay or go
together. Empty tables give empty results. Whole texts count, however long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, mixing, quality, secrets
from tessera.llm.common import NARROW_ROWS, cut, ensure_checkpoint_dir, lookup, read, shielded

#: The near-duplicates of the corpus: five words, a similarity of 0.8 or more.
NEAR = jaccard.Join(words=5, num=80, den=100)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    labels = read(spark, sf_dir, "labels").filter(~quality.is_held_out())
    docs, named = shielded(docs, "doc_id", "text")
    return named(quality.score(docs, quality.train(docs, labels, "quality")).filter("score >= 0.5"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id. Rows without an id stay."""
    gone = cut(jaccard.groups(docs, NEAR).filter("doc_id <> component_id").select("doc_id").distinct())
    return lookup(docs, gone, ["doc_id"], gone.count(), "left_anti", most=NARROW_ROWS).select(docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; n_chars follows."""
    docs, named = shielded(docs, "text", "n_chars")
    return named(secrets.redact(secrets.scan(docs)).withColumn("n_chars", F.length("text").cast("long")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, repeated as often as it takes them."""
    return mixing.mixed_rows(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the bytes that they decode to."""
    return bpe.digests(docs, *bpe.default_vocabulary())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

#: Trained weights and iterated groups aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written to the shared folder and read again."""
    home = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{home}/{k}-{name}", compression="zstd")
            docs = spark.read.parquet(f"{home}/{k}-{name}")
    return docs
