"""Counters, coverage, percentiles and roll-ups. Every shuffle here carries partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variants
from ..functions.numbers import percent, rate
from . import selection


def group_counts(rows: DataFrame, key: str, distinct: str, name: str = "documents", total: str = "chunks") -> DataFrame:
    """key, distinct values and rows per key; null and empty keys are '<missing>'."""
    k = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("<missing>"))
    return rows.groupBy(k.alias("key")).agg(F.count_distinct(distinct).alias(name), F.count("*").alias(total))


def totals(rows: DataFrame, distinct: str, nullable: str) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.count_distinct(distinct).alias("distinct"), F.count(nullable).alias("present"))


def violations(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value is null or not allowed."""
    return rows.agg(F.count_if(F.col(column).isNull() | ~F.col(column).isin(*allowed)).alias("violations"))


def coverage(rows: DataFrame, done: DataFrame, key: str, *by: str, bad: int = 0) -> DataFrame:
    """expected, embedded, pending, percent and complete, over all or by groups: one join, one aggregation, both sides under rows' own filter."""
    joined = rows.select(key, *by).join(done.select(key, F.lit(1).alias("_d")).distinct(), key, "left")
    out = joined.groupBy(*by).agg(F.count("*").alias("expected"), F.count("_d").alias("embedded")).withColumn("pending", F.greatest(F.col("expected") - F.col("embedded"), F.lit(0)))
    return out.withColumns({"percent": percent(F.col("embedded"), F.col("expected")), "complete": (F.col("expected") > 0) & (F.col("pending") == 0) & F.lit(bad == 0)})


def blockers(status: DataFrame, families: DataFrame, required: list[str]) -> DataFrame:
    """status: complete, documents, terminal_documents, run (struct or null: expected, discovered, added, revised, unchanged,
    terminal, errors). Returns blockers in fixed order; without a run the list ends there."""
    have = families.filter("documents > 0").agg(F.coalesce(F.collect_set("key"), F.array().cast("array<string>")).alias("_have"))
    lost = F.array_except(F.array(*map(F.lit, required)), "_have")
    run = F.col("run")
    processed = sum((F.coalesce(run[c], F.lit(0)) for c in ("added", "revised", "unchanged", "terminal")), F.lit(0))
    terminal = F.coalesce(run["terminal"], F.lit(0))
    has = run.isNotNull()
    want = run["discovered"] - terminal
    say = [
        F.when(~F.col("complete"), "embedding coverage or source policy is incomplete"),
        F.when(F.size(lost) > 0, F.concat(F.lit("missing source families: "), F.array_join(lost, ", "))),
        F.when(~has, "no successful complete run is recorded"),
        F.when(has & ((run["expected"] <= 0) | (run["expected"] != run["discovered"]) | (processed != run["expected"])), "the latest complete run did not process its manifest"),
        F.when(has & (F.coalesce(run["errors"], F.lit(0)) != 0), "the latest complete run recorded errors"),
        F.when(has & (F.col("terminal_documents") != terminal), "terminal documents differ from the accepted run"),
        F.when(has & (F.col("documents") != want), F.concat(F.lit("searchable documents "), F.col("documents").cast("string"), F.lit(" differ from the expected "), want.cast("string"))),
    ]
    return status.crossJoin(F.broadcast(have)).select(F.array_compact(F.array(*say)).alias("blockers"))  # one row each


def shard_readiness(expected: DataFrame, versions: DataFrame, minimum_attempts: int = 3, most_issues: int = 100) -> DataFrame:
    """expected: canonical_id, shard. versions: canonical_id, shard_id, version_id, is_current, resolution, attempts, chunk_status,
    chunk_count, chunks, embedded (a row per current version). Returns a row per shard."""
    v = versions.withColumn("_n", F.count("*").over(Window.partitionBy("canonical_id")))
    j = expected.join(v, "canonical_id", "left")
    one, version = F.coalesce(F.col("_n"), F.lit(0)) == 1, F.col("version_id").isNotNull() & F.coalesce("is_current", F.lit(False))
    place = F.coalesce(F.col("shard_id") == F.col("shard"), F.lit(False))
    terminal = F.coalesce(F.col("resolution").isin("missing_at_source", "unparseable"), F.lit(False))
    off = F.array_compact(F.array(
        F.when(F.coalesce("attempts", F.lit(0)) < minimum_attempts, "too few attempts"),
        F.when(~place, "terminal document has incorrect shard"),
        F.when((F.col("chunk_status") != "failed") | (F.col("chunk_count") != 0), "terminal document has an invalid chunk lifecycle"),
        F.when((F.col("chunks") != 0) | (F.col("embedded") != 0), "terminal document still has searchable rows"),
    ))
    chunked = place & F.coalesce((F.col("resolution") == "indexed") & (F.col("chunk_status") == "complete") & (F.col("chunk_count") > 0) & (F.col("chunks") == F.col("chunk_count")), F.lit(False))
    embedded = chunked & (F.col("embedded") == F.col("chunk_count"))
    live = one & version
    issues = (
        F.when(~one, F.array(F.concat(F.lit("current version count="), F.coalesce("_n", F.lit(0)).cast("string"))))
        .when(~version, F.array(F.lit("current version missing")))
        .when(terminal, off)
        .otherwise(F.array_compact(F.array(F.when(~chunked, "chunk lifecycle incomplete"), F.when(~embedded, "embeddings incomplete"))))
    )
    j = j.select("canonical_id", "shard", "resolution", "chunks", "embedded", issues.alias("issues"), (live & terminal & (F.size(off) == 0)).alias("t"), (live & ~terminal & chunked).alias("c"), (live & ~terminal & embedded).alias("e"), live.alias("live"))
    sums = j.groupBy("shard").agg(
        F.count("*").alias("expected"), F.count_if("c").alias("chunked"), F.count_if("t").alias("terminal"), F.count_if(F.col("t") & (F.col("resolution") == "missing_at_source")).alias("missing_at_source"),
        F.count_if("e").alias("embedded_documents"), F.coalesce(F.sum(F.when(F.col("live"), F.col("chunks"))), F.lit(0)).alias("chunks"), F.coalesce(F.sum(F.when(F.col("live"), F.col("embedded"))), F.lit(0)).alias("embedded_chunks"),
    )
    # a limit within the window, so that tasks drop what is beyond it before the shuffle
    said = j.select("shard", F.explode("issues").alias("issue"), "canonical_id").select("shard", F.concat("canonical_id", F.lit(": "), "issue").alias("issue"))
    first = said.withColumn("_r", F.row_number().over(Window.partitionBy("shard").orderBy("issue"))).filter(F.col("_r") <= most_issues)
    issues = first.groupBy("shard").agg(F.array_sort(F.collect_list("issue")).alias("issues"))
    return selection.null_safe(sums, issues, ["shard"], "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<string>")))


def manifest_readiness(shards: DataFrame, most_issues: int = 100) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("expected", "chunked", "terminal", "missing_at_source", "embedded_documents", "chunks", "embedded_chunks")]
    # a shard keeps at most most_issues, so the list of all has a bound too
    return shards.agg(*sums, F.slice(F.array_sort(F.flatten(F.collect_list("issues"))), 1, most_issues).alias("issues")).withColumn("ready", (F.size("issues") == 0) & (F.col("expected") > 0))


def digest(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """md5 of all values in byte order, joined by commas: the identity of a bounded set of ids, or of each of the groups that they are dealt
    to. Without groups it is the digest of a whole set, which one task holds; a large set takes groups (shards) and their digests."""
    return rows.groupBy(*by).agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.col(column).cast("string"))), ",")).alias("digest"))


def distribution(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, n_scored, min, median and max, nulls left out of all but n."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count(value).alias("n_scored"), F.min(value).alias("min"), F.max(value).alias("max"))
    middle = selection.order_statistics(rows, value, list(keys), selection.MIDDLE)
    return with_statistics(sums, middle, list(keys)).select(*keys, "n", "n_scored", "min", ((F.col("below") + F.col("above")) / 2).alias("median"), "max")


def with_statistics(sums: DataFrame, statistics: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregates by keys with the order statistics of the same groups, null for groups without values."""
    return selection.null_safe(sums, statistics, keys, "left") if keys else sums.join(F.broadcast(statistics), F.lit(True), "left")  # one row each


def histogram(rows: DataFrame, key: str, domain: DataFrame | None = None) -> DataFrame:
    """key and n in order of key; with a domain (column key), zeros too."""
    n = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return (n if domain is None else domain.join(n, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))).orderBy("key")


def counters(log: DataFrame, payload: str, path: str, *keys: str) -> DataFrame:
    """Counts by keys and a JSON path of the payload."""
    return log.groupBy(*keys, variants.at(variants.parsed(F.col(payload)), path).alias("value")).agg(F.count("*").alias("n"))


def named_counters(log: DataFrame, **conditions: Column) -> DataFrame:
    """name and n for each condition, in one pass."""
    one = log.agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))
    pairs = ", ".join(f"'{n}', `{n}`" for n in conditions)
    return one.select(F.expr(f"stack({len(conditions)}, {pairs}) as (name, n)"))


def sorted_groups(rows: DataFrame, keys: list[str], name: str = "rows") -> DataFrame:
    """Rows of each key as an array of structs in canonical order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).filter(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).distinct()


def nested_status(runs: DataFrame, key: str = "run_id") -> DataFrame:
    """runs: key, sections array<struct<cells: array<struct<status>>>>. Counts of cells by status."""
    cells = runs.select(key, F.explode_outer(F.flatten(F.transform("sections", lambda s: s["cells"]))).alias("c"))
    names = ("populated", "verified_absent", "analyst_input_required")
    return cells.groupBy(key).agg(*(F.count_if(F.col("c.status") == n).alias(n) for n in names))


def sections_of(chunks: DataFrame, *keys: str) -> DataFrame:
    """section_path, first ordinal and member ids in order, per document."""
    rows = chunks.filter("section_path is not null and section_path <> ''")
    return rows.groupBy(*keys, "section_path").agg(F.min("ordinal").alias("first_ordinal"), F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "chunk_id"))), lambda x: x["chunk_id"]).alias("members"))


# --- evaluation --------------------------------------------------------------------------------------------------------


def item_scores(hits: DataFrame, expected: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """hits: item_id, rank, keys; expected: item_id, keys; items: item_id.
    item_id, recall (1 if any expected source was hit; 1 if none is expected), reciprocal_rank, citation_precision."""
    want = expected.select("item_id", *keys).distinct()
    joined = hits.join(want.withColumn("_w", F.lit(1)), ["item_id", *keys], "left")
    per = joined.groupBy("item_id").agg(F.min(F.when(F.col("_w") == 1, F.col("rank"))).alias("_first"), F.avg(F.coalesce("_w", F.lit(0))).alias("citation_precision"))
    n = want.groupBy("item_id").agg(F.count("*").alias("_n"))
    out = items.join(per, "item_id", "left").join(n, "item_id", "left")
    none, first = F.col("_n").isNull(), F.col("_first")
    return out.select(*items.columns, F.when(none, 1.0).when(first.isNotNull(), 1.0).otherwise(0.0).alias("recall"), F.when(none, 1.0).otherwise(F.coalesce(1.0 / first, F.lit(0.0))).alias("reciprocal_rank"), F.coalesce("citation_precision", F.lit(0.0)).alias("citation_precision"))


def scorecard(details: DataFrame, *keys: str) -> DataFrame:
    """details: must_refuse, must_clarify, refused, withheld, clarified, errored, skipped, answer_unmeasured (booleans), recall,
    reciprocal_rank, citation_precision, faithfulness, fact_recall (null without facts), latency_ms.

    Distinct denominators: answerable rows (wrong refusals count 0), answered rows, and rows that can be scored.
    keys group it; rollup(details, key) adds the grand total."""
    c = F.col
    decision = c("must_refuse") | c("must_clarify")
    answerable = ~decision & ~c("errored")
    answered = answerable & ~c("answer_unmeasured")
    scored = ~c("skipped") & ~c("errored")
    right = F.when(c("must_refuse"), c("withheld")).when(c("must_clarify"), c("clarified")).otherwise(~c("refused"))
    over = lambda value, rows: F.coalesce(F.sum(F.when(rows, F.coalesce(value, F.lit(0.0)))), F.lit(0.0)) / F.greatest(F.count_if(rows), F.lit(1))
    sums = details.groupBy(*keys).agg(
        F.count("*").alias("n"),
        over(c("recall"), answerable).alias("recall_at_k"),
        over(c("reciprocal_rank"), answerable).alias("mrr"),
        over(c("citation_precision"), answered).alias("citation_precision"),
        over(c("faithfulness"), answered).alias("faithfulness"),
        F.coalesce(F.avg(F.when(answered, c("fact_recall"))), F.lit(0.0)).alias("fact_recall"),
        over(right.cast("double"), scored).alias("decision_accuracy"),
        F.count_if(c("errored")).alias("errored"),
        F.count_if(c("skipped")).alias("skipped"),
    )
    ranks = {"latency_p50_ms": selection.nearest_rank(0.5), "latency_p95_ms": selection.nearest_rank(0.95)}
    return with_statistics(sums, selection.order_statistics(details.filter("not errored"), "latency_ms", list(keys), ranks), list(keys))


def by_category(details: DataFrame, category: str = "category") -> DataFrame:
    """The scorecard's main rates per category and, with a null category, over all."""
    c = F.col
    answerable = ~c("must_refuse") & ~c("must_clarify") & ~c("errored")
    return details.rollup(category).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), rate(F.sum(F.when(answerable, F.coalesce("recall", F.lit(0.0)))), F.count_if(answerable)).alias("recall_at_k"), rate(F.sum(F.when(answerable, F.coalesce("reciprocal_rank", F.lit(0.0)))), F.count_if(answerable)).alias("mrr"))


def threshold_curve(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """rows: must_refuse, must_clarify, max_score, refused. thresholds: t, a bounded grid.

    Per t: refuse_recall, answer_retention, decision_accuracy; a null score keeps its observed refusal, refusing is
    score < t, clarifying rows are left out. The rows are first counted by score, so the grid meets distinct scores only."""
    use = rows.filter(~F.col("must_clarify")).groupBy("must_refuse", "max_score", "refused").agg(F.count("*").alias("n"))
    no = F.when(F.col("max_score").isNull(), F.col("refused")).otherwise(F.col("max_score") < F.col("t"))
    met = use.crossJoin(F.broadcast(thresholds)).withColumn("no", no)
    must, n = F.col("must_refuse"), F.col("n")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    share = lambda part, whole: F.when(whole == 0, 1.0).otherwise(part / whole)
    return met.groupBy("t").agg(share(total(must & F.col("no")), total(must)).alias("refuse_recall"), share(total(~must & ~F.col("no")), total(~must)).alias("answer_retention"), share(total(must == F.col("no")), F.sum("n")).alias("decision_accuracy"))


def recommended(rows: DataFrame, curve: DataFrame, current: float) -> DataFrame:
    """The threshold of largest refuse_recall that retains what current retains (the lower of equals), and whether the score
    ranges overlap; null without scored rows on both sides."""
    at = curve.agg(F.min_by("answer_retention", F.struct(F.abs(F.col("t") - current), "t")).alias("floor"))
    best = curve.crossJoin(F.broadcast(at)).filter("answer_retention >= floor").agg(F.max_by("t", F.struct("refuse_recall", -F.col("t"))).alias("best"))
    sides = rows.filter(~F.col("must_clarify")).agg(F.min(F.when(~F.col("must_refuse"), F.col("max_score"))).alias("lo"), F.max(F.when(F.col("must_refuse"), F.col("max_score"))).alias("hi"))
    both = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    return sides.crossJoin(best).select(F.when(both, F.col("best")).alias("recommended"), F.coalesce(both & (F.col("lo") <= F.col("hi")), F.lit(False)).alias("overlap"))


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count("*").alias("n"))


def route_report(rows: DataFrame) -> DataFrame:
    """rows: attempted, outcome, agrees_with_mode, agrees_with_scope, latency_ms, cost_usd. Rates are null without data."""
    a = F.col("attempted")
    n = F.count_if(a)
    agree = lambda c: rate(F.count_if(a & F.col(c)), F.count_if(a & F.col(c).isNotNull()))
    sums = rows.agg(
        F.count("*").alias("total_rows"), n.alias("attempted"), rate(n - F.count_if(a & (F.col("outcome") == "success")), n).alias("failure_rate"), rate(F.count_if(a & (F.col("outcome") == "invalid")), n).alias("parse_failure_rate"),
        agree("agrees_with_mode").alias("mode_agreement"), agree("agrees_with_scope").alias("scope_agreement"),
        F.max(F.when(a, F.col("latency_ms"))).alias("latency_max"), F.coalesce(F.sum(F.when(a, F.col("cost_usd"))), F.lit(0.0)).alias("total_cost_usd"),
    )
    ranks = {"p50": selection.nearest_rank(0.5), "p95": selection.nearest_rank(0.95)}
    return with_statistics(sums, selection.order_statistics(rows.filter("attempted"), "latency_ms", [], ranks), [])


def compare_arms(ranks: DataFrame, base: str, other: str) -> DataFrame:
    """ranks: arm, item_id, rank (null: no hit). Hit rate and mean reciprocal rank per arm, their differences, and whether these
    exceed one item's weight."""
    per = ranks.groupBy("arm").agg(F.count("*").alias("n"), F.avg(F.col("rank").isNotNull().cast("double")).alias("hit_rate"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))
    a, b = per.filter(F.col("arm") == base), per.filter(F.col("arm") == other)
    both = a.select(*(F.col(c).alias(f"base_{c}") for c in ("n", "hit_rate", "mrr"))).crossJoin(b.select(*(F.col(c).alias(f"other_{c}") for c in ("n", "hit_rate", "mrr"))))  # one row each
    gain = F.col("other_hit_rate") - F.col("base_hit_rate")
    return both.withColumns({"hit_gain": gain, "mrr_gain": F.col("other_mrr") - F.col("base_mrr"), "beyond_noise": F.abs(gain) > 1.0 / F.greatest("base_n", "other_n")})


def expectations(cells: DataFrame, gold: DataFrame) -> DataFrame:
    """gold: cell_id, expect_status, expect_value_contains, expect_evidence_source. Each gold row with whether it is met."""
    j = gold.join(cells, "cell_id", "left")
    ok = (F.col("status") == F.col("expect_status")) & (F.col("expect_value_contains").isNull() | F.contains(F.lower("value"), F.lower("expect_value_contains"))) & (F.col("expect_evidence_source").isNull() | F.array_contains("evidence_sources", F.col("expect_evidence_source")))
    return j.select("cell_id", F.coalesce(ok, F.lit(False)).alias("met"))
