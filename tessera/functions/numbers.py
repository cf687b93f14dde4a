"""Measured values, acceptance limits, vectors, hashes, dates and small arithmetic, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def measured(c: Column) -> Column:
    """'0.17%', '< 0.05', '+81', '1,234' -> double; 'ND' and 'N/A' are null."""
    s = F.replace(c.cast("string"), F.lit(","), F.lit(""))
    none = s.rlike(r"(?i)\bnd\b|not detected|n/?a")
    return F.when(~none, F.nullif(F.regexp_extract(s, r"[-+]?\d+(?:\.\d+)?", 0), F.lit("")).cast("double"))


def limit(c: Column) -> Column:
    """struct<kind, low, high> of an acceptance limit: range, max or min; null where none can be read.

    Numbers are unsigned, so a negative bound loses its sign; 'max' and 'min' also count inside other words."""
    s = F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("%"), F.lit(" "))
    n = F.transform(F.regexp_extract_all(s, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    made = lambda kind, low, high: F.struct(F.lit(kind).alias("kind"), low.cast("double").alias("low"), high.cast("double").alias("high"))
    null, first = F.lit(None), F.try_element_at(n, F.lit(1))
    return (
        F.when((F.size(n) >= 2) & s.rlike(r"(?i)-|–|to|between"), made("range", F.array_min(n), F.array_max(n)))
        .when((F.size(n) > 0) & s.rlike(r"(?i)nmt|not more than|≤|<=|<|max"), made("max", null, first))
        .when((F.size(n) > 0) & s.rlike(r"(?i)nlt|not less than|≥|>=|>|min"), made("min", first, null))
    )


def satisfies(value: Column, lim: Column) -> Column:
    return F.when(lim["kind"] == "max", value <= lim["high"]).when(lim["kind"] == "min", value >= lim["low"]).when(lim["kind"] == "range", value.between(lim["low"], lim["high"]))


def inline_limit(c: Column) -> Column:
    """struct<value, limit> of a cell such as '1.3 (0.9 - 1.5)'; null unless both can be read."""
    value, lim = measured(F.regexp_extract(c, r"(?s)^(.*?)\([^)]*\)", 1)), limit(F.regexp_extract(c, r"\(([^)]*)\)", 1))
    return F.when(c.rlike(r"\([^)]*\)") & value.isNotNull() & lim.isNotNull(), F.struct(value.alias("value"), lim.alias("limit")))


def collapse_near(values: Column) -> Column:
    """Sorted distinct values, without those within 1 % (0.001 at least) of one kept before."""
    near = lambda v, k: F.abs(v - k) <= F.greatest(F.lit(0.001), k * 0.01)
    return F.aggregate(F.array_sort(F.array_distinct(values)), F.array().cast("array<double>"), lambda a, v: F.when(F.exists(a, lambda k: near(v, k)), a).otherwise(F.concat(a, F.array(v))))


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; null for zero vectors and unequal lengths."""
    return F.when(F.size(a) == F.size(b), 1 - F.try_divide(dot(a, b), norm(a) * norm(b)))


def score(distance: Column) -> Column:
    """Similarity in 0..1 from a cosine distance: clamp(1 - d / 2)."""
    return F.greatest(F.least(1 - distance / 2, F.lit(1.0)), F.lit(0.0))


def unit(v: Column, dim: int | None = None) -> Column:
    """v scaled to length 1; an error for null or non-finite components or another dimension, zero vectors stay."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if dim is not None:
        bad = bad | (F.size(v) != dim)
    length = norm(v)
    return F.when(bad, F.raise_error(F.lit("not a finite vector of the profile's dimension")).cast("array<double>")).otherwise(F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double"))))


#: Fixed value: shards of a corpus.
SHARDS = 512


def shard(c: Column) -> Column:
    """The first 8 bytes of the trimmed id's SHA-256, big-endian, modulo 512: its low 9 bits."""
    return (F.conv(F.substring(F.sha2(F.trim(c), 256), 13, 4), 16, 10).cast("int") % SHARDS).cast("int")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns' canonical JSON: keys sorted, nulls kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def profile_id(*columns: Column) -> Column:
    return F.concat(F.lit("ep_"), F.substring(fingerprint(*columns), 1, 32))


def artifact_path(namespace: Column, digest: Column) -> Column:
    """Content-addressed place of an artifact."""
    return F.concat_ws("/", namespace, F.substring(digest, 1, 2), digest)


def token_estimate(c: Column, divisor: int = 4) -> Column:
    return F.ceil(F.length(c) / divisor).cast("long")


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Null unless the price and both token counts are known."""
    return (tokens_in * price_in + tokens_out * price_out) / 1_000_000


def iso_date(c: Column) -> Column:
    """MM/DD/YYYY or 'Mon d, YYYY' to a date; null if it is neither."""
    return F.coalesce(F.to_date(F.try_to_timestamp(c, F.lit("MM/dd/yyyy"))), F.to_date(F.try_to_timestamp(c, F.lit("MMM d, yyyy"))))


def run_status(status: Column, started: Column, now: Column, minutes: int) -> Column:
    """Pending and running runs older than so many minutes count as failed."""
    return F.when(status.isin("pending", "running") & (F.timestamp_diff("MINUTE", started, now) > minutes), "failed").otherwise(status)


def rate(part: Column, whole: Column) -> Column:
    """part / whole; null without data."""
    return F.try_divide(part, F.nullif(whole, F.lit(0)))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to two places; 0 for an empty whole."""
    return F.when(whole == 0, 0.0).otherwise(F.round(100.0 * part / whole, 2))
