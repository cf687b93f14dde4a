"""Window-shaped operators: keepers of duplicates, elections, runs, rates and the recent turns of a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def losers(rows: DataFrame, keys: list[str], id_: str, *newest: str) -> DataFrame:
    """Duplicates of a key but for the newest one (ids are distinct), each with keeper, the newest one's id. The newest ones are
    aggregated before they are joined back, so that a key of very many copies isn't one task."""
    top = rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.max_by(id_, F.struct(*newest)).alias("keeper"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(top, same).filter(F.col(id_) != F.col("keeper")).select(*rows.columns, "keeper")


def elected(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by order: at most one is current."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def follows(sections: DataFrame, document: str = "doc_id", node: str = "node_id", order: str = "first_ordinal") -> DataFrame:
    """src, dst of sections that follow each other."""
    nxt = F.lead(node).over(Window.partitionBy(document).orderBy(order, node))
    return sections.select(document, F.col(node).alias("src"), nxt.alias("dst")).filter("dst is not null")


def carried(rows: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """The last non-null value so far."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def first_match(hits: DataFrame, query: str, matches: Column, *order: Column) -> DataFrame:
    """query and the 1-based rank of its first matching hit, null if there is none."""
    ranked = hits.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    return ranked.groupBy(query).agg(F.min(F.when(matches, F.col("_r"))).alias("rank"))


def recent_turns(messages: DataFrame, session: str, turn: str, role: str, content: str, status: str, newest: list[Column], limit: int = 3) -> DataFrame:
    """Up to limit newest completed turns of each session, oldest first (column position).

    Only the newest 8 * limit messages are looked at; a turn needs a user and an assistant message (the newest of each role)
    and the latter's status must be answer, summary or null."""
    w = Window.partitionBy(session).orderBy(*newest)
    recent = messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit * 8)
    side = lambda r, c: F.min_by(F.when(F.col(role) == r, c), F.when(F.col(role) == r, F.col("_n")))
    turns = recent.groupBy(session, turn).agg(
        F.min("_n").alias("_at"), F.count_if(F.col(role) == "user").alias("_u"), F.count_if(F.col(role) == "assistant").alias("_a"),
        side("user", F.col(content)).alias("question"), side("assistant", F.col(content)).alias("answer"), side("assistant", F.struct(F.col(status).alias("s")))["s"].alias("status"),
    )
    done = turns.filter((F.col("_u") > 0) & (F.col("_a") > 0) & F.coalesce("status", F.lit("answer")).isin("answer", "summary"))
    kept = done.withColumn("_k", F.row_number().over(Window.partitionBy(session).orderBy("_at"))).filter(F.col("_k") <= limit)
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc("_at")))
    return kept.select(session, turn, back.alias("position"), F.trim("question").alias("question"), F.trim("answer").alias("answer"), "status")


def latest_scope(messages: DataFrame, session: str, scope: str, newest: list[Column], most: int = 50) -> DataFrame:
    """The newest non-null scope among the newest so many messages of each session."""
    w = Window.partitionBy(session).orderBy(*newest)
    recent = messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    return recent.groupBy(session).agg(F.min_by(scope, F.when(F.col(scope).isNotNull(), F.col("_n"))).alias("scope"))


def calls_within(events: DataFrame, key: str, stamp: str, seconds: int = 60) -> DataFrame:
    """Calls of the key in the seconds up to each call, it included. An approximation of the limiter: denied calls count too
    (streaming.rate_limited is exact)."""
    return events.withColumn("calls", F.expr(f"count(*) over (partition by {key} order by {stamp} range between interval {seconds} seconds preceding and current row)"))


def reject_duplicates(rows: DataFrame, key: str) -> DataFrame:
    """rows, or an error when they are read if a key occurs twice."""
    n = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate id "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def abort_at(outcomes: DataFrame, group: str, order: str, failed: str, canary: int, most: int) -> DataFrame:
    """Per group the first position where a run must stop: the first canary outcomes all failed, or most in a row did (0: off)."""
    w = Window.partitionBy(group).orderBy(order)
    rows = outcomes.withColumns({"_n": F.row_number().over(w), "_ok": F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w)})
    run = F.count_if(F.col(failed)).over(Window.partitionBy(group, "_ok").orderBy(order))
    rows = rows.withColumn("_run", run)
    stop = (F.lit(canary > 0) & (F.col("_n") == canary) & (F.col("_ok") == 0)) | (F.lit(most > 0) & (F.col("_run") >= most))
    return rows.groupBy(group).agg(F.min(F.when(stop, F.col("_n"))).alias("stop_at"))


def runs(rows: DataFrame, partition: str, order: str, *same: str) -> DataFrame:
    """run: numbers consecutive rows whose columns same stay equal, from 0."""
    w = Window.partitionBy(partition).orderBy(order)
    changed = ~F.struct(*same).eqNullSafe(F.lag(F.struct(*same)).over(w))
    return rows.withColumn("_c", changed.cast("int")).withColumn("run", F.sum("_c").over(w) - 1).drop("_c")


def within_budget(rows: DataFrame, partition: str, order: str, size: Column, budget: int) -> DataFrame:
    """Rows while their total size stays within the budget; the first always."""
    w = Window.partitionBy(partition).orderBy(order)
    return rows.withColumns({"_t": F.sum(size).over(w), "_n": F.row_number().over(w)}).filter((F.col("_t") <= budget) | (F.col("_n") == 1)).drop("_t", "_n")


def assigned_before(items: DataFrame, starts: DataFrame, document: str, position: str, value: str) -> DataFrame:
    """Each item with the value of the last start at or before its position: a backward as-of join by union and window."""
    a = starts.select(document, F.col(position), F.lit(0).alias("_side"), F.struct(F.col(value).alias("v")).alias("_v"), *(F.lit(None).cast(items.schema[c].dataType).alias(c) for c in items.columns if c not in (document, position)))
    b = items.select(document, F.col(position), F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_v"].dataType).alias("_v"), *(c for c in items.columns if c not in (document, position)))
    w = Window.partitionBy(document).orderBy(position, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").select(*items.columns, F.col("_v.v").alias(value))
