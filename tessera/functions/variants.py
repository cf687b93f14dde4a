"""JSON text as VARIANT: parsed once, asked by path and type, malformed text as null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(c: Column) -> Column:
    """VARIANT; null for null and for text that isn't JSON."""
    return F.try_parse_json(c)


def at(v: Column, path: str, kind: str = "string") -> Column:
    """The value at a path as a type; null where it is missing or no such type."""
    return F.try_variant_get(v, path, kind)


def kind_at(v: Column, path: str) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN, VOID (a JSON null), or null where nothing is there."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)


def is_object(v: Column, path: str = "$") -> Column:
    return F.coalesce(kind_at(v, path) == "OBJECT", F.lit(False))


#: What kind_at() may say for a type that a schema asks for.
KINDS = {"string": ("STRING",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def faults(v: Column, required: dict[str, str], optional: dict[str, str] | None = None) -> Column:
    """array<string>: what is wrong with a JSON object, in the order of the fields: not_json, not_object, missing:field, type:field."""
    out = []
    for fields, must in ((required, True), (optional or {}, False)):
        for name, kind in fields.items():
            have = kind_at(v, f"$.{name}")
            gone = have.isNull() | (have == "VOID")
            out.append(F.when(gone, F.lit(f"missing:{name}") if must else F.lit(None)).when(~have.isin(*KINDS[kind]), f"type:{name}"))
    return F.when(v.isNull(), F.array(F.lit("not_json"))).when(~is_object(v), F.array(F.lit("not_object"))).otherwise(F.array_compact(F.array(*out)))


def fields(rows: DataFrame, v: str) -> DataFrame:
    """rows with a row for each field of the object in v: key, value (VARIANT). Rows without an object go."""
    return rows.filter(is_object(F.col(v))).lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(v).outer())).drop("pos")
