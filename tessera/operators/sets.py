"""Set operations: order-preserving distinctness, reconciliation, change kinds and merges by trust."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import canonical_name, ingredients, squeeze


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in order, rows without an order before all: an aggregate, so a hot key is reduced before the shuffle."""
    first = F.min_by(F.struct(*rows.columns), F.struct(F.col(order).isNotNull(), order))
    return rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(first.alias("_r")).select("_r.*")


def retired(active: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Active rows that the manifest no longer lists. An empty manifest is an error: it would retire everything."""
    n = manifest.agg(F.count("*").alias("_n"))
    gone = active.join(manifest.select(key).distinct(), key, "left_anti").crossJoin(F.broadcast(n))  # one row
    return gone.filter(F.when(F.col("_n") == 0, F.raise_error(F.lit("the manifest is empty")).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def keys_of(*tables: DataFrame, key: str) -> DataFrame:
    return reduce(lambda a, b: a.union(b), (t.select(key) for t in tables)).distinct()


def ingredient_keys(*columns: tuple[DataFrame, str]) -> DataFrame:
    """Distinct canonical keys of the ingredients in several tables' columns."""
    raw = reduce(lambda a, b: a.union(b), (t.select(F.col(c).alias("raw")).distinct() for t, c in columns)).distinct()
    return raw.select(F.explode(ingredients(F.col("raw"))).alias("part")).select(canonical_name(F.col("part")).alias("key")).filter("key <> ''").distinct()


def change_kinds(found: DataFrame, versions: DataFrame) -> DataFrame:
    """found: doc_key, content_hash. versions: doc_key, content_hash, captured_at, version_id. found with kind: added without any
    version, unchanged if its hash is the latest version's, error if it is an older one's (a reversion can't be told from
    a repeat), else revised."""
    last = versions.groupBy("doc_key").agg(F.max_by("content_hash", F.struct("captured_at", "version_id")).alias("_last"))
    old = versions.select("doc_key", "content_hash", F.lit(True).alias("_old")).distinct()
    j = found.join(last, "doc_key", "left").join(old, ["doc_key", "content_hash"], "left")
    kind = F.when(F.col("_last").isNull(), "added").when(F.col("content_hash") == F.col("_last"), "unchanged").when(F.col("_old"), "error").otherwise("revised")
    return j.withColumn("kind", kind).drop("_last", "_old")


#: Authority by class of evidence.
AUTHORITY = {"code_verified": 3, "checklist": 2, "quote_anchored": 1, "model_judgment": 0}


def deduplicated_findings(findings: DataFrame) -> DataFrame:
    """One finding per normal title (60 characters), section and table: the highest authority, of equals the first; precedents
    of any go to it if it has none."""
    norm = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in AUTHORITY.items() for x in kv))[F.col("evidence_class")], F.lit(0))
    keys = [F.substring(norm(F.col("title")), 1, 60).alias("_a"), norm(F.col("section")).alias("_b"), norm(F.col("table_ref")).alias("_c")]
    has = F.size(F.coalesce("precedents", F.array().cast("array<string>"))) > 0
    best = F.max_by(F.struct(*findings.columns), F.struct(rank, -F.col("position")))
    out = findings.groupBy(*keys).agg(best.alias("f"), F.min_by(F.when(has, F.col("precedents")), F.when(has, F.col("position"))).alias("_p"))
    own = F.when(F.size(F.coalesce("f.precedents", F.array().cast("array<string>"))) > 0, F.col("f.precedents"))
    return out.select(*(F.coalesce(own, "_p").alias(c) if c == "precedents" else F.col(f"f.{c}").alias(c) for c in findings.columns))


def split_by_known(tokens: DataFrame, known: DataFrame, group: str, order: str, token: str, parses) -> DataFrame:
    """Distinct tokens per group in first-seen order with valid: they parse and are known."""
    first = tokens.groupBy(group, F.trim(token).alias(token)).agg(F.min(order).alias(order))
    j = first.join(known.select(F.col(token), F.lit(True).alias("_k")).distinct(), token, "left")
    return j.select(group, token, order, (parses(F.col(token)).isNotNull() & F.coalesce("_k", F.lit(False))).alias("valid"))


#: Trust in a watchlist's sources.
TRUST = {"manual": 3, "drugsfda": 2, "orange_book": 1}


def merged_watchlist(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by identity (name, number, form and route without case): a source of at least equal trust overwrites with what it
    has, a lesser one only fills blanks; incoming rows of unknown sources are refused. Columns: active_ingredient,
    normalized_name, dosage_form, route, rld_name, rld_application_number, company_status, source, source_url."""
    ident = lambda c: F.lower(squeeze(F.col(c)))
    keys = {"_n": F.col("normalized_name"), "_a": F.col("rld_application_number"), "_f": ident("dosage_form"), "_r": ident("route")}
    trust = F.create_map(*(F.lit(x) for kv in TRUST.items() for x in kv))
    old = current.select(F.struct(*current.columns).alias("o"), *(v.alias(k) for k, v in keys.items()))
    new = incoming.filter(F.col("source").isin(*TRUST)).select(F.struct(*current.columns).alias("n"), *(v.alias(f"{k}2") for k, v in keys.items()))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}2")) for k in keys))
    j = old.join(new, same, "full_outer")
    over = F.coalesce(trust[F.col("n.source")], F.lit(0)) >= F.coalesce(trust[F.col("o.source")], F.lit(0))
    full = lambda c: F.nullif(F.col(c), F.lit(""))

    def pick(c: str):
        if c in ("company_status", "rld_name", "source_url"):
            both = F.when(over, F.coalesce(full(f"n.{c}"), F.col(f"o.{c}"))).otherwise(F.coalesce(full(f"o.{c}"), F.col(f"n.{c}")))
        elif c == "source":
            both = F.when(over, F.col("n.source")).otherwise(F.col("o.source"))
        else:
            both = F.col(f"o.{c}")
        return F.when(F.col("o").isNull(), F.col(f"n.{c}")).when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(both).alias(c)

    return j.select(*(pick(c) for c in current.columns), F.col("o").isNull().alias("added"))
