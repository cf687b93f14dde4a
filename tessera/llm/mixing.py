"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 60-bit hash of its id, and one of its text and place. Sizes are summed by source and hash bucket; a window over at most
a few thousand buckets of a source finds the bucket in which the running sum passes the budget; only that
bucket is refined with the next bits, until a single hash value remains: the threshold. Rows are then kept
by comparing hashes with thresholds; nothing is sorted by row. Where several rows share the threshold (repeated or null ids),
they are refined by their second hash in the same way. Where the row at the threshold is larger
than what is left, a next round fills the rest from later hashes of rows that fit (nested thresholds).

Defined results: null or empty texts have size 0 and are never taken; null sources form one source, ordered
last; rows of one id follow each other in the order of their second hash, so a mix may take some of them; that hash has the place of
a row among docs' rows, so docs must be read in a stable order (files, or a cut table) for reruns to agree; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, lookup, read, shielded

#: Bits of the hash, and the shifts at which buckets are counted: 4096 buckets, 4096 in the boundary one, then its single hashes:
#: one in 2^24 of a source's rows (some 6000 of 10^11).
HASH_BITS, SHIFTS = 60, (48, 36, 0)
TOP = 1 << HASH_BITS


def keyed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """docs with size (words), skey (source with a place for null), h (60-bit hash of the id) and h2 (of text and place)."""
    digest = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")), 256)
    return docs.withColumns({
        "size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        "skey": F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("a"), "source")),
        "h": F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"),
        "h2": F.shiftrightunsigned(F.xxhash64("text", F.monotonically_increasing_id()), 64 - HASH_BITS),
    })


def running(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """rows with the sum of a column over the rows before, by new name; order tells all rows apart. Rows are dealt to ranges of the
    order: sums of the ranges before, plus sums within the range."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    past = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = dealt.groupBy("range").agg(*(F.sum(c).alias(f"sum_{n}") for n, c in sums.items()))
    over_ranges = Window.orderBy("range")  # as many rows as shuffle partitions
    ranges = ranges.select("range", *(past(f"sum_{n}", over_ranges).alias(f"to_{n}") for n in sums))
    within = Window.partitionBy("range").orderBy(*order)
    out = dealt.join(F.broadcast(ranges), "range").withColumns({n: past(c, within) + F.col(f"to_{n}") for n, c in sums.items()})
    return out.drop("range", *(f"to_{n}" for n in sums))


def targets(base: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """skey, source_size, target: weights repeat over the sources in code-point order; a target stops at
    most * source_size and the excess goes to the others by weight (water filling, in closed form)."""
    src = running(base.groupBy("skey").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1)), ["skey"], {"rank": "one"})
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    src = src.withColumns({"w": w, "most": F.col("source_size") * most}).withColumn("ratio", F.col("most") / F.col("w"))
    src = running(src, ["ratio", "rank"], {"before": "most", "w_before": "w"})
    total, w_all = src.agg(F.sum("source_size"), F.sum("w")).first()
    level = (F.lit(total or 0) - F.col("before")) / (F.lit(w_all or 0) - F.col("w_before"))
    src = src.withColumn("level", level)
    share = src.filter("level <= ratio").agg(F.min_by("level", F.struct("ratio", "rank"))).first()[0]
    return src.select("skey", "source_size", F.least(F.col("w") * F.lit(share).cast("double"), F.col("most").cast("double")).alias("target"))


def _narrowed(rows: DataFrame, budgets: DataFrame, n: int) -> DataFrame:
    """rows: skey, h, size. budgets: skey, budget. Returns skey, thr, left, tied for each budget: the sizes of rows with
    h < thr sum to budget - left, and with the tied rows at thr they would pass the budget (thr is TOP if all fit)."""
    state = budgets.select("skey", F.col("budget").alias("left"), F.lit(None).cast("long").alias("at"))
    first = None
    for k, shift in enumerate(SHIFTS):
        near = lookup(rows, state, ["skey"], n)
        if k:
            near = near.filter(F.shiftright("h", SHIFTS[k - 1]) == F.col("at"))
        hist = near.groupBy("skey", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("w"), F.first("left").alias("left"), F.count("*").alias("tied"))
        run = hist.withColumn("cum", F.sum("w").over(Window.partitionBy("skey").orderBy("b")))
        found = run.groupBy("skey").agg(
            F.min(F.when(F.col("cum") > F.col("left"), F.struct("b", (F.col("left") - F.col("cum") + F.col("w")).alias("left"), "tied"))).alias("m"),
            F.sum("w").alias("all"),
        )
        if not k:
            first = found = cut(found)
        state = found.filter("m is not null").select("skey", F.col("m.left").alias("left"), F.col("m.b").alias("at"), F.col("m.tied").alias("tied"))
        if k:
            state = cut(state)
        last, state = state, state.drop("tied")
    fits = first.filter("m is null").select("skey", F.col("all"))
    out = budgets.join(last, "skey", "left").join(fits, "skey", "left")
    left = F.coalesce("left", F.col("budget") - F.coalesce("all", F.lit(0)))
    return cut(out.select("skey", F.coalesce("at", F.lit(TOP)).alias("thr"), left.alias("left"), F.coalesce("tied", F.lit(0)).alias("tied")))


def threshold(rows: DataFrame, budgets: DataFrame, n: int) -> DataFrame:
    """rows: skey, h, h2, size. budgets: skey, budget. Returns skey, thr, thr2, left for each budget: the sizes of rows with
    h < thr, or h = thr and h2 < thr2, sum to budget - left."""
    out = _narrowed(rows.select("skey", "h", "size"), budgets, n)
    tied = out.filter("tied > 1")
    m = tied.count()
    if not m:
        return out.select("skey", "thr", F.lit(0).cast("long").alias("thr2"), "left")
    near = lookup(rows, tied.select("skey", "thr"), ["skey"], m).filter("h = thr").select("skey", F.col("h2").alias("h"), "size")
    inner = _narrowed(near, tied.select("skey", F.col("left").alias("budget")), m).select("skey", F.col("thr").alias("thr2"), F.col("left").alias("left2"))
    return cut(out.join(inner, "skey", "left").select("skey", "thr", F.coalesce("thr2", F.lit(0)).alias("thr2"), F.coalesce("left2", "left").alias("left")))


def budgets(base: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, rounds: int = 3) -> tuple[DataFrame, int]:
    """base: skey, size, h, h2 of all rows. Returns a row per source (target, whole repeats, thresholds) and their number."""
    goal = cut(targets(base, weights, most))
    n = goal.count()
    whole = F.when(F.col("target") >= F.col("source_size") * most, most).when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = goal.withColumn("whole", whole).withColumn("budget", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    step = plan.select("skey", "budget")
    for k in range(rounds):
        rows = base.filter("size > 0").select("skey", "h", "h2", "size")
        if k:
            prev = last.select("skey", F.col("thr").alias("from"), F.col("thr2").alias("from2"), F.col("left").alias("fits"))
            rows = lookup(rows, prev, ["skey"], n).filter("(h > `from` or h = `from` and h2 >= from2) and size <= fits").select("skey", "h", "h2", "size")
        last = threshold(rows, step, n)
        plan = plan.join(last.select("skey", F.struct("thr", "thr2").alias(f"at{k}"), F.col("left").alias(f"left{k}")), "skey", "left")
        step = last.select("skey", F.col("left").alias("budget"))
    took = [(F.col("at0"), F.lit(TOP))] + [(F.col(f"at{k}"), F.col(f"left{k - 1}")) for k in range(1, rounds)]
    return cut(plan.select("skey", "source_size", "target", "whole", F.array(*(F.struct(t.alias("at"), m.cast("long").alias("fits")) for t, m in took)).alias("steps"))), n


def take(rows: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """rows (skey, size, h, h2 and any others) with source_size, target and repeats: how often the mix takes the row."""
    extra = F.exists("steps", lambda s: (F.struct(F.col("h").alias("thr"), F.col("h2").alias("thr2")) < s["at"]) & (F.col("size") <= s["fits"]))
    times = F.when(F.col("size") > 0, F.col("whole") + F.when(extra, 1).otherwise(0)).otherwise(0)
    return lookup(rows, plan, ["skey"], n).withColumn("repeats", times.cast("long")).drop("whole", "steps")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, rounds: int = 3, seed: str = "mix") -> DataFrame:
    """docs: doc_id, source, text. Returns doc_id, source, size, source_size, target, taken (size times repeats)."""
    base = cut(keyed(docs.select("doc_id", "source", "text"), seed).drop("text"))
    plan, n = budgets(base, weights, most, rounds)
    return take(base, plan, n).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, rounds: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes them, with docs' columns."""
    docs, named = shielded(docs, "doc_id", "source", "text")
    rows = keyed(docs, seed)
    plan, n = budgets(cut(rows.select("skey", "size", "h", "h2")), weights, most, rounds)
    taken = take(rows, plan, n).filter("repeats > 0")
    return named(taken.withColumn("repeats", F.explode(F.sequence(F.lit(1), F.col("repeats")))))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = """
WITH base AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS skey,
         ('0x' || substr(sha256(doc_id::VARCHAR || ':mix'), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (SELECT skey, sum(size)::BIGINT AS source_size FROM base GROUP BY skey),
s1 AS (SELECT *, row_number() OVER (ORDER BY encode(skey)) AS rank, sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS most FROM s1),
s3 AS (SELECT *, most / w AS ratio FROM s2),
s4 AS (SELECT *, coalesce(sum(most) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
              sum(w) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from FROM s3),
s5 AS (SELECT *, (total - before)::DOUBLE / w_from AS level FROM s4),
s6 AS (SELECT *, (SELECT level FROM s5 WHERE level <= ratio ORDER BY ratio, rank LIMIT 1) AS share FROM s5),
goal AS (SELECT skey, source_size, least(w * share, most::DOUBLE) AS target FROM s6),
plan AS (SELECT *, CASE WHEN target >= source_size * 3 THEN 3 WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM goal),
plan2 AS (SELECT *, floor(target - whole * source_size)::BIGINT AS budget FROM plan),
r1 AS (SELECT b.*, p.source_size, p.target, p.whole, p.budget,
              sum(CASE WHEN size > 0 THEN size ELSE 0 END) OVER (PARTITION BY skey ORDER BY h) AS c1 FROM base b JOIN plan2 p USING (skey)),
t1 AS (SELECT *, size > 0 AND c1 <= budget AS in1, budget - coalesce(max(CASE WHEN c1 <= budget THEN c1 END) OVER (PARTITION BY skey), 0) AS left1 FROM r1),
r2 AS (SELECT *, sum(CASE WHEN size > 0 AND NOT in1 AND size <= left1 THEN size ELSE 0 END) OVER (PARTITION BY skey ORDER BY h) AS c2 FROM t1),
t2 AS (SELECT *, size > 0 AND NOT in1 AND size <= left1 AND c2 <= left1 AS in2,
              left1 - coalesce(max(CASE WHEN c2 <= left1 THEN c2 END) OVER (PARTITION BY skey), 0) AS left2 FROM r2),
r3 AS (SELECT *, sum(CASE WHEN size > 0 AND NOT in1 AND NOT in2 AND size <= left2 THEN size ELSE 0 END) OVER (PARTITION BY skey ORDER BY h) AS c3 FROM t2)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN in1 OR in2 OR (size > 0 AND size <= left2 AND c3 <= left2) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r3
"""
