"""Exact order statistics of groups of any size, by refining counts.

Values of a group are counted in BUCKETS ranges between its least and its greatest value. The range that holds a rank is counted
again between its own least and greatest value, until one value is left. Counts are made before the shuffle, so a task holds
at most BUCKETS numbers a group, and after the first step only the rows of ranges that hold a rank take part.

Null values are left out; NaN is above all numbers. A group without values has no row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut, small

BUCKETS = 1024
Rank = Callable[[Column], Column]


def nearest_rank(p: float) -> Rank:
    """The value at rank ceil(n p), from 1."""
    return lambda n: F.greatest(F.ceil(n * F.lit(p)) - 1, F.lit(0))


def rounded_index(p: float) -> Rank:
    """The value at index round(p (n - 1)), from 0, halves to even. Callers take 0 for groups without values."""
    return lambda n: F.bround(F.lit(p) * (n - 1), 0)


def truncated_index(p: float) -> Rank:
    """The value at index int(p (n - 1)), from 0."""
    return lambda n: F.floor(F.lit(p) * (n - 1))


#: The two values whose mean is the median.
MIDDLE: dict[str, Rank] = {"below": lambda n: F.floor((n - 1) / 2), "above": lambda n: F.floor(n / 2)}


def _bucket(v: Column, lo: Column, hi: Column) -> Column:
    """A number that never falls with v; lo and hi are apart whatever rounding does to the rest."""
    half = lambda c: c.cast("double") / 2
    span = half(hi) - half(lo)
    place = F.floor((half(v) - half(lo)) / span * BUCKETS)
    usable = (span > 0) & (span < float("inf"))
    return F.when(v == lo, 0).when(v == hi, BUCKETS - 1).when(usable, F.greatest(F.least(place, F.lit(BUCKETS - 1)), F.lit(0))).otherwise(1).cast("int")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi join on keys that may be null, with left's keys."""
    other = right.withColumnsRenamed({k: f"_{k}_" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys]
    return left.join(other, on, how).drop(*(f"_{k}_" for k in keys))


def order_statistics(rows: DataFrame, value: str, keys: list[str], ranks: dict[str, Rank]) -> DataFrame:
    """A row for each group by keys with its values at ranks (places from 0, as a function of the number of values)."""
    by = keys or ["_all"]
    rows = rows.withColumn("_all", F.lit(0)) if not keys else rows
    rows = rows.select(*by, F.col(value).alias("_v")).filter("_v is not null")
    spans = cut(rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    groups = spans.count()

    def counted(state: DataFrame, size: int, own: list[str]) -> DataFrame:
        near = null_safe(rows, small(state, size), by).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        hist = near.groupBy(*by, *own, _bucket(F.col("_v"), F.col("_lo"), F.col("_hi")).alias("_b")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        all_of = Window.partitionBy(*by, *own)
        return hist.withColumns({"_before": F.sum("_c").over(all_of.orderBy("_b")) - F.col("_c"), "_n": F.sum("_c").over(all_of)})

    held = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c"))
    state_of = lambda df: df.filter(held).select(*by, "_name", (F.col("_rank") - F.col("_before")).alias("_rank"), "_lo", "_hi")
    places = F.explode(F.array(*(F.struct(F.lit(name).alias("_name"), rank(F.col("_n")).cast("long").alias("_rank")) for name, rank in ranks.items())))
    state = cut(state_of(counted(spans, groups, []).withColumn("_p", places).select("*", "_p.*")))
    apart = ~F.col("_lo").eqNullSafe(F.col("_hi"))
    done, todo = [state.filter(~apart)], state.filter(apart)
    while n := todo.count():
        state = cut(state_of(counted(todo, n, ["_name", "_rank"])))
        done.append(state.filter(~apart))
        todo = state.filter(apart)
    every = done[0]
    for d in done[1:]:
        every = every.union(d)
    out = every.groupBy(*by).agg(*(F.max(F.when(F.col("_name") == name, F.col("_lo"))).alias(name) for name in ranks))
    return out if keys else out.drop("_all")
