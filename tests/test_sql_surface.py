"""SQL functions against the column functions of the same name, and the table function against the array expressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import names, numbers, registered, text
from tessera.plans import chunking

NAMES = [None, "", "  ", "Metformin Hydrochloride", "b (x) and A", "Zinc Sulfate; SODIUM chloride / Iron", "sodium", "x,y ,z", "A  AND\tb", "naïve Citrate", "it's \\ odd"]
NUMBERS = [None, "", "NDA 12", "anda-000123", "n1", "B 9", "0000001234567", "1234567", "12", "x", "NDA", "٣", "nda 1234567"]


def test_sql_functions_are_the_column_functions(spark):
    registered.register(spark)
    df = spark.createDataFrame([(n,) for n in NAMES], "s string").createOrReplaceTempView("t_names")
    df = spark.sql("select s, canonical_name(s) a, stripped_name(s) b, token_set(s) c, shard_id(s, 512) d from t_names")
    same = df.select("s", *(x.eqNullSafe(F.col(c)).alias(c) for c, x in {"a": names.canonical_name(F.col("s")), "b": names.stripped_name(F.col("s")), "c": text.tokens(F.col("s")), "d": numbers.shard(F.col("s"))}.items()))
    assert all(all(r[1:]) for r in same.collect())
    spark.createDataFrame([(n,) for n in NUMBERS], "s string").createOrReplaceTempView("t_numbers")
    rows = spark.sql("select s, app_no(s) a from t_numbers").select("s", "a", names.application_number(F.col("s")).alias("b")).collect()
    assert [(r.s, r.a) for r in rows] == [(r.s, r.b) for r in rows]
    got = spark.sql("select jaccard(array('a','b'), array('b','c')) j, jaccard(array(), array('a')) z, cosine_score(array(1D,0D), array(0D,1D)) s, cosine_score(array(1D), array(1D,2D)) n, cosine_score(array(0D), array(1D)) o").first()
    assert tuple(got) == (1 / 3, 0.0, 0.5, None, None)


def test_sql_functions_are_inlined(spark):
    registered.register(spark)
    plan = spark.sql("select canonical_name(cast(id as string)) from range(3)")._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(" in plan and "Python" not in plan


PAGES = [
    "I. First heading of this\n" + "Words of a section. " * 30 + "\nA. Short one\nx",
    "Goes on without a heading. " * 200,
    None,
    "  \n ",
    "Option 1: Another\n" + "long " * 2000 + "\nII. Next\nmore text follows here, quite a bit of it, to be kept apart from the rest of all. " * 9,
    "tail",
]


def test_chunk_document_is_the_array_expression(spark):
    registered.register(spark)
    docs = spark.createDataFrame([(1, PAGES), (2, PAGES[::-1]), (3, ["only"]), (4, [])], "doc_id long, pages array<string>")
    want = sorted(map(tuple, chunking.chunked_by_columns(docs).select("doc_id", "ordinal", "page", "section_path", "text").collect()))
    pages = docs.select("doc_id", F.posexplode("pages").alias("page", "text")).withColumn("page", F.col("page") + 1).withColumn("other", F.lit("x")).repartition(5)
    got = sorted(map(tuple, spark.sql("select doc_id, ordinal, page, section_path, text from chunk_document(TABLE({p}))", p=pages).collect()))
    assert got == want and len(got) > 10
    stripped = lambda f: sorted(map(tuple, f(docs, strip=True).select("doc_id", "ordinal", "page", "section_path", "text").collect()))
    assert stripped(chunking.chunked) == stripped(chunking.chunked_by_columns)
    assert sorted(map(tuple, chunking.chunked(docs).select("doc_id", "ordinal", "page", "section_path", "text").collect())) == want


def test_documents_in_sql(spark):
    registered.register(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.lit(1).alias("page"), "text")
    got = spark.sql("select doc_id, ordinal, text from chunk_document(TABLE({p}))", p=docs)
    want = chunking.chunked_by_columns(docs.select("doc_id", F.array(F.coalesce("text", F.lit(""))).alias("pages"))).select("doc_id", "ordinal", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_chunk_document_names_what_is_missing(spark):
    registered.register(spark)
    with pytest.raises(Exception, match="no text"):
        spark.sql("select * from chunk_document(TABLE({p}))", p=spark.range(1).selectExpr("id as doc_id", "1 as page")).collect()
