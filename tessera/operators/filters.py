"""A filter language over metadata columns, compiled to Column predicates that Catalyst pushes into the scan.

{field: value} is equality; {field: {"$eq": v}}, {field: {"$in": [...]}}; {"$and": [filters]}; several keys are a
conjunction. Unknown fields and operators are errors; an empty $in matches nothing; values of integer fields that aren't
integers (booleans included) match nothing; null rows match nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import small


class FilterError(ValueError):
    pass


def _coerced(value: Any, integer: bool) -> Any:
    if not integer:
        return None if value is None else str(value)
    if isinstance(value, bool):
        return None
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def compile_filter(where: Mapping[str, Any] | None, fields: Mapping[str, str]) -> Column:
    """fields: the allowed columns and their kinds, 'int' or 'text'."""
    if not where:
        return F.lit(True)
    parts = []
    for key, want in where.items():
        if key == "$and":
            parts += [compile_filter(w, fields) for w in want]
            continue
        if key.startswith("$"):
            raise FilterError(f"unknown operator {key}")
        if key not in fields:
            raise FilterError(f"unknown field {key}")
        integer = fields[key] == "int"
        if not isinstance(want, Mapping):
            want = {"$eq": want}
        for op, value in want.items():
            if op == "$eq":
                parts.append(F.col(key) == F.lit(_coerced(value, integer)))
            elif op == "$in":
                values = [v for v in (_coerced(x, integer) for x in value) if v is not None]
                parts.append(F.col(key).isin(values) if values else F.lit(False))
            else:
                raise FilterError(f"unknown operator {op}")
    return all_of(parts)


def all_of(predicates: Iterable[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, (p for p in predicates if p is not None), F.lit(True))


def without_blanks(flat: Mapping[str, Any]) -> dict[str, Any]:
    """Filters without None, '' and []; lists become $in."""
    kept = {k: v for k, v in flat.items() if v not in (None, "", [])}
    return {k: {"$in": list(v)} if isinstance(v, (list, tuple, set)) else v for k, v in kept.items()}


def stored_casing(values: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """wanted (column value) with stored: the one stored spelling that equals it without case, else the value itself."""
    spelled = values.select(column).filter(F.col(column).isNotNull()).groupBy(F.lower(column).alias("_key")).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    one = spelled.filter("_lo = _hi").select("_key", F.col("_lo").alias("_one"))
    return wanted.join(one, F.lower(F.col("value")) == F.col("_key"), "left").select(*wanted.columns, F.coalesce("_one", "value").alias("stored"))


def in_stored(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """rows whose value is one of those stored in values (one column): $in for lists of any length, as a semi-join."""
    return rows.join(values.toDF("_in").filter("_in is not null").distinct(), F.col(column) == F.col("_in"), "left_semi")


def in_namespaces(column: str, allowed: Iterable[str], or_null: bool = True) -> Column:
    inside = F.col(column).isin(*allowed)
    return inside | F.col(column).isNull() if or_null else inside


def equal_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def like_any(column: Column, parts: Iterable[str]) -> Column:
    """Case-insensitive containment of any of the parts."""
    return reduce(lambda a, b: a | b, (F.contains(F.lower(column), F.lit(p.lower())) for p in parts), F.lit(False))


def whole_word(column: Column, term: str) -> Column:
    import re

    return column.rlike(rf"(?i)\b{re.escape(term)}\b") if term else F.lit(False)


def above_floor(rows: DataFrame, floor: float, query: str = "query_id", score: str = "score") -> DataFrame:
    """Rows at or above the floor, of queries whose best row reaches it."""
    best = F.max(score).over(Window.partitionBy(query))
    return rows.withColumn("_best", best).filter((F.col("_best") >= floor) & (F.col(score) >= floor)).drop("_best")


def since(rows: DataFrame, stamp: Column, start: str | None) -> DataFrame:
    """Rows at or after start (an ISO string); without start all rows. Compared as timestamps in UTC."""
    return rows if start is None else rows.filter(F.to_timestamp(stamp) >= F.to_timestamp(F.lit(start)))


def provenance(rows: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows all of whose provenance keys are in allowed together."""
    return rows.join(allowed.select(*keys).distinct(), keys, "left_semi")


#: Retrieval modes: what may run, and what needs a product.
EXACT, EXACT_SCOPED, APPROXIMATE = "exact", "exact_scoped", "approximate"


def default_mode(scope: Mapping[str, Any]) -> str:
    return EXACT_SCOPED if scope.get("normalized_name") or scope.get("appl_no") else EXACT


def assert_mode(mode: str, scope: Mapping[str, Any]) -> None:
    if mode == APPROXIMATE:
        raise FilterError("approximate retrieval is not admitted")
    if mode not in (EXACT, EXACT_SCOPED):
        raise FilterError(f"unknown mode {mode}")
    if mode == EXACT_SCOPED and default_mode(scope) != EXACT_SCOPED:
        raise FilterError("scoped retrieval needs a product key")


def checked_small(df: DataFrame) -> DataFrame:
    """df for a broadcast whose size is counted first."""
    return small(df, df.count())
