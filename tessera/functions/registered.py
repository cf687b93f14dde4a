"""The engine's functions under SQL names: SQL-language functions, which Catalyst inlines; Arrow UDFs for sequential algorithms; and
table functions, of a text or of a table argument."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from . import sequential
from .names import APPLICATION_TYPES, ONE_LETTER, SALTS, SEPARATOR
from .text import ABBREVIATIONS


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_SQUEEZE = r"trim(regexp_replace({}, '(?U)\\s+', ' '))"
_PARTS = f"filter(transform(split(coalesce(name, ''), {_quoted(SEPARATOR)}), p -> trim(p)), p -> p <> '')"
_PLAIN = rf"lower({_SQUEEZE.format(r"regexp_replace(p, '\\([^)]*\\)', ' ')")})"
_SALT_FREE = f"array_join(filter(split({_PLAIN}, ' '), t -> t <> '' AND NOT array_contains(array({', '.join(map(_quoted, SALTS))}), t)), ' ')"
_KIND = f"regexp_extract(upper(regexp_replace(raw, '[^A-Za-z0-9]', '')), '^({'|'.join(APPLICATION_TYPES)}|[{''.join(ONE_LETTER)}])0*([0-9]{{1,6}})$', "
_DIGITS = "regexp_replace(raw, '[^0-9]', '')"
_LONG = " ".join(f"WHEN '{letter}' THEN '{name}'" for letter, name in ONE_LETTER.items())
_WORD = r"lower(regexp_extract(try_element_at(a, -1), '([A-Za-z][A-Za-z.]*)\\.$', 1))"

#: Name, parameters, type and body of the SQL-language functions.
SQL_FUNCTIONS = {
    "canonical_name": ("name STRING", "STRING", f"array_join(array_sort(filter(transform({_PARTS}, p -> {_PLAIN}), p -> p <> '')), '; ')"),
    "stripped_name": ("name STRING", "STRING", f"array_join(array_sort(filter(transform({_PARTS}, p -> {_SALT_FREE}), p -> p <> '')), '; ')"),
    "app_no": (
        "raw STRING", "STRING",
        f"CASE WHEN raw IS NULL OR raw = '' THEN NULL WHEN {_KIND}2) <> '' THEN concat(CASE {_KIND}1) {_LONG} ELSE {_KIND}1) END, lpad({_KIND}2), 6, '0')) "
        f"WHEN {_DIGITS} = '' OR length(ltrim('0', {_DIGITS})) > 6 THEN NULL WHEN length({_DIGITS}) < 6 THEN lpad({_DIGITS}, 6, '0') ELSE {_DIGITS} END",
    ),
    "token_set": ("body STRING", "ARRAY<STRING>", r"filter(array_distinct(split(lower(coalesce(body, '')), '(?U)[^\\p{L}\\p{N}]+')), t -> t <> '')"),
    "split_sentences": (
        "body STRING", "ARRAY<STRING>",
        rf"aggregate(filter(split(coalesce(body, ''), '(?U)(?<=[.!?])\\s+'), p -> p RLIKE '(?U)\\S'), CAST(array() AS ARRAY<STRING>), (a, b) -> CASE WHEN coalesce(CASE {_WORD} "
        rf"WHEN 'ph' THEN startswith(lower(ltrim(b)), 'eur') ELSE contains({_WORD}, '.') OR array_contains(array({', '.join(map(_quoted, ABBREVIATIONS))}), {_WORD}) END, false) "
        r"THEN concat(slice(a, 1, size(a) - 1), array(concat_ws(' ', element_at(a, -1), b))) ELSE concat(a, array(b)) END)",
    ),
    "jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END"),
    "shard_id": ("id STRING, shards INT", "INT", "CAST(conv(substring(sha2(trim(id), 256), 13, 4), 16, 10) AS INT) % shards"),
    "cosine_score": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        # vectors of one length are divided by its square, which no root has rounded; the score is 1 - distance / 2 as in numbers.score
        "CASE WHEN size(a) = size(b) THEN transform(transform(array(struct(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) AS d, "
        "aggregate(a, 0D, (s, x) -> s + x * x) AS m, aggregate(b, 0D, (s, x) -> s + x * x) AS n)), t -> try_divide(t.d, CASE WHEN t.m = t.n THEN t.m ELSE sqrt(t.m) * sqrt(t.n) END)), "
        "c -> CASE WHEN c IS NOT NULL THEN greatest(0D, least(1D, 1 - (1 - c) / 2)) END)[0] END",
    ),
}


class MarkdownUnits:
    """Rows of a text's markdown units."""

    def eval(self, body: str) -> Iterator[tuple]:
        for u in sequential.markdown_units(body):
            yield u.text, u.kind, u.group, u.item, u.cell, u.level, u.width


class ChunkDocument:
    """Chunks of the documents in a table argument of doc_id, page and text: chunk_document(TABLE(pages)).

    The function itself asks for a partition per doc_id in order of page. A page's rows are cut when it is read; a
    partition keeps the section that goes on and the number of the next chunk, nothing else."""

    def __init__(self):
        self.path, self.ordinal = None, 0

    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable or not isinstance(pages.dataType, T.StructType):
            raise ValueError("chunk_document takes a table: chunk_document(TABLE(pages))")
        missing = {"doc_id", "page", "text"} - set(pages.dataType.fieldNames())
        if missing:
            raise ValueError(f"the table has no {', '.join(sorted(missing))}")
        schema = T.StructType([pages.dataType["doc_id"], T.StructField("ordinal", T.IntegerType()), T.StructField("page", T.IntegerType()), T.StructField("section_path", T.StringType()), T.StructField("text", T.StringType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("page")])

    def eval(self, row: Row) -> Iterator[tuple]:
        from ..plans.chunking import page_chunks

        chunks, self.path = page_chunks(row["text"], self.path)
        for path, text in chunks:
            yield row["doc_id"], self.ordinal, row["page"], path, text
            self.ordinal += 1


def register(spark: SparkSession) -> list[str]:
    """Registers all functions for this session and returns their names."""
    for name, (parameters, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, f in sequential.udfs().items():
        spark.udf.register(name, f)
    spark.udtf.register("markdown_rows", F.udtf(MarkdownUnits, returnType="text: string, kind: string, `group`: int, item: int, cell: int, level: int, width: int"))
    spark.udtf.register("chunk_document", F.udtf(ChunkDocument))
    return [*SQL_FUNCTIONS, *sequential.udfs(), "markdown_rows", "chunk_document"]
