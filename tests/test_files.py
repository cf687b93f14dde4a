"""Sources from files, sinks to folders, addresses, and streams that are run."""

from __future__ import annotations

import datetime as dt
import random
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import registered
from tessera.operators import merge
from tessera.plans import corpus
from tessera.sources import delimited, markup, records
from tessera.streaming import queries as streams


def test_tilde_and_tabs(spark, tmp_path):
    (tmp_path / "p.txt").write_text('﻿Ingredient~DF;Route~Trade_Name~Appl_No\nASPIRIN  "X"~TABLET;ORAL~ A ~000123\n', "utf-8")
    r = delimited.tilde(spark, str(tmp_path / "p.txt"), delimited.PRODUCTS).first()
    assert (r["ingredient"], r["dosage_form_route"], r["trade_name"], r["appl_no"], r["rld"]) == ('ASPIRIN "X"', "TABLET;ORAL", "A", "000123", None)
    (tmp_path / "a.tsv").write_text("ApplNo\tSponsorName\n123\tACME – “é” \n", "cp1252")
    assert delimited.tab_separated(spark, str(tmp_path / "a.tsv"), {"ApplNo"}).first().asDict() == {"ApplNo": "000123", "SponsorName": "ACME – “é”"}
    assert delimited.table_set(spark, str(tmp_path), {"a": {"ApplNo"}}, ".tsv")["a"].count() == 1
    with pytest.raises(delimited.SourceError):
        delimited.table_set(spark, str(tmp_path), {"a": {"ApplNo"}, "b": set()}, ".tsv")
    with pytest.raises(delimited.SourceError):
        delimited.tab_separated(spark, str(tmp_path / "a.tsv"), {"ApplNo", "ApplType"})


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("deep/er/patent.txt", "Appl_Type~Appl_No\nX~9\n")
        z.writestr("b/patent.txt", "Appl_Type~Appl_No\nN~1\n")
        z.writestr("a/patent.txt", "Appl_Type~Appl_No\nA~2\n")
    rows = delimited.member(spark, str(tmp_path / "z.zip"), "patent.txt", {"appl_type": "Appl_Type", "appl_no": "Appl_No"}).collect()
    assert [tuple(r) for r in rows] == [("A", "2")]
    with pytest.raises(PySparkException):
        delimited.member(spark, str(tmp_path / "z.zip"), "none.txt", {"a": "Appl_Type"}).collect()


def test_json_lines_and_manifest(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('# gold\n{"id": "1", "n": 2}\n\n{"id": "2"}\n')
    assert [tuple(r) for r in records.json_lines(spark, str(tmp_path / "g.jsonl"), "id string, n int", ["id"]).collect()] == [("1", 2), ("2", None)]
    (tmp_path / "m.json").write_text('{"schema_version": 2, "artifacts": [{"id": "x"}]}')
    assert records.manifest(spark, str(tmp_path / "m.json"), "id:string", 2).first()["id"] == "x"
    with pytest.raises(PySparkException):
        records.manifest(spark, str(tmp_path / "m.json"), "id:string", 3).collect()


def test_listing_and_sections(spark):
    row = '<tr class="drugData"><td><a href="/psg/PSG_012345.pdf" title="Aspirin Sodium">x</a></td><td></td><td>Draft</td><td>Oral</td><td>Tablet</td><td><a>12345</a></td><td>01/02/2020</td></tr>'
    r = markup.listings(spark.createDataFrame([(1, f"<table>{row}{row}</table>")], "page_id long, html string")).collect()
    assert len(r) == 1 and (r[0]["appl_no"], r[0]["stripped_name"], r[0]["psg_type"], r[0]["rld_or_rs_numbers"], r[0]["recommended_date"]) == ("012345", "aspirin", "draft", ["012345"], dt.date(2020, 1, 2))
    with pytest.raises(PySparkException):
        markup.listings(spark.createDataFrame([(1, "<p>none</p>")], "page_id long, html string")).collect()
    xml = '<document xmlns="urn:hl7-org:v3"><section><code code="1-1"/><title>One</title><text>a  b</text></section><section><code code="1-1"/><text>later</text></section></document>'
    assert [tuple(r) for r in markup.sections(spark.createDataFrame([(7, xml)], "doc_id long, xml string")).collect()] == [(7, 0, "1-1", "One", "a b")]


@pytest.mark.parametrize(
    "url, family, want",
    [
        ("http://fda.gov/media/163638/download#x", "fda_be_guidance", "https://www.fda.gov/media/163638/download"), ("https://fda.gov/media/163638/download/more", "fda_be_guidance", None), ("https://fda.gov/media/1/download", "fda_be_guidance", None),
        ("https://www.accessdata.fda.gov/scripts/cder/daf/index.cfm?a=1", "drugs_at_fda", "https://www.accessdata.fda.gov/scripts/cder/daf/index.cfm?a=1"), ("https://evil.org/scripts/cder/daf/", "drugs_at_fda", None),
        ("https://fda.gov/scripts/cder/daf/%2e%2e/x", "drugs_at_fda", None), ("https://u:p@fda.gov/scripts/cder/daf/", "drugs_at_fda", None), ("https://fda.gov:8443/scripts/cder/daf/", "drugs_at_fda", None),
    ],
)
def test_addresses(spark, url, family, want):
    assert spark.range(1).select(records.canonical_url(F.lit(url), family).alias("u")).first()["u"] == want


def test_swapped_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        merge.swap_in(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    (tmp_path / "t").rename(tmp_path / "t.old-1")  # a driver that died between the renames
    assert merge.recovered(spark, path) and spark.read.parquet(path).count() == 5
    rows = spark.createDataFrame([("b", None), ("a", 1)], "canonical_id string, n int")
    digest = merge.write_manifest(rows, str(tmp_path / "m"))
    assert sorted(map(tuple, merge.read_manifest(spark, str(tmp_path / "m"), digest, "canonical_id string, n int").collect())) == [("a", 1), ("b", None)]
    with pytest.raises(ValueError):
        merge.read_manifest(spark, str(tmp_path / "m"), "0-0", "canonical_id string, n int")


def test_manifest_identity_counts_repeats(spark):
    one = spark.createDataFrame([("a", "f"), ("b", "f")], "canonical_id string, source_family string")
    digest = lambda df: corpus.manifest_identity(df).first()["digest"]
    assert len({digest(one), digest(one.limit(1)), digest(one.union(one))}) == 3
    assert digest(one) == digest(one.orderBy(F.desc("canonical_id")))


def test_sync_twice_adds_nothing(spark, tmp_path):
    source, target, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for k in range(2):
        spark.range(4).select("id", F.lit(k).alias("batch")).write.mode("append").parquet(source)
        streams.sync(spark, source, "id long, batch int", target, ["id"], cp)
        assert spark.read.parquet(target).count() == 4
    streams.sync(spark, source, "id long, batch int", target, ["id"], str(tmp_path / "other"))  # a replay of everything
    assert spark.read.parquet(target).count() == 4


def test_limiter_as_a_stream(spark, tmp_path):
    rng, start = random.Random(2), dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i * 7), rng.randint(1, 3)) for i in range(120)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    for k in range(3):
        table.filter(F.col("event_id").between(40 * k, 40 * k + 39)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.rate_limited(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "user_id", 2, 60.0)
    got = streams.finished(stream, "limited", str(tmp_path / "cp"), "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streams.rate_limited(table, "user_id", 2, 60.0).collect()))


def test_registered_functions(spark):
    assert {"quote_match", "split_sentences", "markdown_rows"} <= set(registered.register(spark))
    assert spark.sql("select token_sort_ratio('a b', 'b a') r, quote_match('two words', 'has two  words here').exact e, size(split_sentences('One. Two.')) n").first() == (100.0, True, 2)
    assert [tuple(r) for r in spark.sql("select kind, text from markdown_rows('# Head\n- one\n- two')").collect()] == [("heading", "Head"), ("bullet", "one"), ("bullet", "two")]
