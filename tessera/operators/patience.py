"""Page-aware differences of document versions by patience alignment, over all pairs of versions at once.

Lines are compared by a digest of their squeezed lower-case form. Every round works on all open segments of all pairs: equal lines
at a segment's beginning and end are matched; of the rest, lines that stand once on each side are anchors, as far as they keep
their order (longest increasing subsequence); the gaps between anchors are the next round's segments. What no round matches is
changed. A round is a few aggregates and windows within segments; only places and digests take part in it."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..tables import cut

#: Budgets in characters of a whole diff (as JSON), of either side of a change, and of one line.
DIFF_BUDGET, SIDE_BUDGET, LINE_BUDGET = 16000, 4000, 1200
#: Line ends: those that a text editor knows, and the separators of records.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
LINES = "array<struct<page:int,text:string>>"


def lines(pages: Column) -> Column:
    """array<struct<page, text>>: squeezed lines that aren't empty, with their pages from 1. Null for null."""
    squeezed = lambda t: F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    per_page = F.transform(pages, lambda p, i: F.transform(F.split(F.coalesce(p, F.lit("")), LINE_END), lambda t: F.struct((i + 1).alias("page"), squeezed(t).alias("text"))))
    return F.filter(F.flatten(per_page), lambda x: x["text"] != "")


def change_summary(old: Column, new: Column) -> Column:
    """initial, whitespace_only or changed, for arrays of pages."""
    keys = lambda pages: F.transform(lines(pages), lambda x: F.lower(x["text"]))
    none = F.array().cast("array<string>")
    return F.when(old.isNull() | (F.size(old) == 0), "initial").when(keys(old) == keys(F.coalesce(new, none)), "whitespace_only").otherwise("changed")


def rising(places: list[int]) -> list[int]:
    """Indices of a longest rising subsequence of distinct numbers."""
    ends: list[int] = []  # the least end of a rising run of each length, and where it stands
    at, before = [], []
    for i, x in enumerate(places):
        k = bisect_left(ends, x)
        before.append(at[k - 1] if k else -1)
        ends[k : k + 1], at[k : k + 1] = [x], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def line_table(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, old, new (arrays of pages) -> pair_id, side (a old, b new), no (from 0), page, text, key."""
    sides = [pairs.select("pair_id", F.lit(side).alias("side"), F.posexplode(lines(F.col(c)))) for side, c in (("a", "old"), ("b", "new"))]
    both = sides[0].union(sides[1])
    return both.select("pair_id", "side", F.col("pos").alias("no"), "col.page", "col.text", F.unhex(F.md5(F.lower("col.text"))).alias("key"))


def unique_on_both(rows: DataFrame, *segment: str) -> DataFrame:
    """rows: segment columns, side, no, key. Places a, b of the lines that stand once on each side."""
    on = lambda s: F.col("side") == s
    g = rows.groupBy(*segment, "key").agg(F.count_if(on("a")).alias("na"), F.count_if(on("b")).alias("nb"), F.min(F.when(on("a"), F.col("no"))).alias("a"), F.min(F.when(on("b"), F.col("no"))).alias("b"))
    return g.filter("na = 1 and nb = 1").select(*segment, "a", "b")


def _bounded(rows: DataFrame, *segment: str) -> DataFrame:
    """rows of segments with lines on both sides, with the segment's bounds; seg is the place where side a begins."""
    own = Window.partitionBy("pair_id", *segment)
    edge = lambda f, side: f(F.when(F.col("side") == side, F.col("no"))).over(own)
    out = rows.withColumns({f"{s}_{n}": edge(f, s) for s in "ab" for n, f in (("lo", F.min), ("hi", F.max))})
    return out.filter("a_lo is not null and b_lo is not null").select("pair_id", "side", "no", "key", F.col("a_lo").alias("seg"), "a_lo", "a_hi", "b_lo", "b_hi")


def _edges(rows: DataFrame) -> DataFrame:
    """rows with head and tail: how many lines at a segment's beginning and end are equal on both sides."""
    lo = F.when(F.col("side") == "a", F.col("a_lo")).otherwise(F.col("b_lo"))
    hi = F.when(F.col("side") == "a", F.col("a_hi")).otherwise(F.col("b_hi"))
    least = F.least(F.col("a_hi") - F.col("a_lo"), F.col("b_hi") - F.col("b_lo")) + 1
    marked = rows.withColumns({"from_lo": F.col("no") - lo, "from_hi": hi - F.col("no"), "least": least})
    for name in ("from_lo", "from_hi"):
        pair = Window.partitionBy("pair_id", "seg", name)
        other = (F.count("*").over(pair) < 2) | (F.min("key").over(pair) != F.max("key").over(pair))
        marked = marked.withColumn(f"{name}_odd", F.when(other, F.col(name)))
    seg = Window.partitionBy("pair_id", "seg")
    head = F.coalesce(F.min("from_lo_odd").over(seg), F.col("least"))
    marked = marked.withColumn("head", head)
    return marked.withColumn("tail", F.least(F.coalesce(F.min("from_hi_odd").over(seg), F.col("least")), F.col("least") - F.col("head"))).drop("from_lo_odd", "from_hi_odd")


def matches(table: DataFrame) -> DataFrame:
    """line_table() -> pair_id, a, b: places of the lines that are the same, rising on both sides."""
    lis = F.pandas_udf(lambda s: pd.Series([rising(list(x)) for x in s]), ArrayType(IntegerType()))
    rows = cut(_bounded(table.select("pair_id", "side", "no", "key").withColumn("seg", F.lit(0)), "seg"))
    found = []
    while not rows.isEmpty():
        rows = cut(_edges(rows))
        at_head, at_tail = F.col("from_lo") < F.col("head"), F.col("from_hi") < F.col("tail")
        old = rows.filter("side = 'a'")
        ends = old.filter(at_head | at_tail).select("pair_id", F.col("no").alias("a"), F.when(at_head, F.col("b_lo") + F.col("from_lo")).otherwise(F.col("b_hi") - F.col("from_hi")).alias("b"))
        inner = rows.filter(~at_head & ~at_tail).select("pair_id", "seg", "side", "no", "key")
        unique = unique_on_both(inner, "pair_id", "seg")
        # the unique lines of a segment: at most a version's lines, as places only
        chains = unique.groupBy("pair_id", "seg").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("c")).withColumn("keep", lis(F.transform("c", lambda x: x["b"])))
        anchors = cut(chains.select("pair_id", "seg", F.explode(F.transform("keep", lambda i: F.get("c", i))).alias("x")).select("pair_id", "seg", "x.a", "x.b"))
        found += [ends, anchors.select("pair_id", "a", "b")]
        marks = anchors.select("pair_id", F.lit("a").alias("side"), F.col("a").alias("no")).union(anchors.select("pair_id", F.lit("b"), "b")).withColumn("anchor", F.lit(1))
        gap = F.coalesce(F.sum("anchor").over(Window.partitionBy("pair_id", "seg", "side").orderBy("no")), F.lit(0))
        # a segment without anchors is done
        more = inner.join(anchors.select("pair_id", "seg").distinct(), ["pair_id", "seg"]).join(marks, ["pair_id", "side", "no"], "left").withColumn("gap", gap).filter("anchor is null")
        rows = cut(_bounded(more, "seg", "gap"))
    out = table.sparkSession.createDataFrame([], table.select("pair_id", F.col("no").alias("a"), F.col("no").alias("b")).schema)
    for f in found:
        out = out.union(f)
    return out


def hunks(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id (unique), old, new (arrays of pages). Changed runs of lines in order: pair_id, hunk (from 0), kind (replace, delete,
    insert), after (old lines before it), removed, added (lines with pages).

    Null versions and pages have no lines."""
    table = cut(line_table(pairs))
    m = cut(matches(table))
    same = m.select("pair_id", F.lit("a").alias("side"), F.col("a").alias("no")).union(m.select("pair_id", F.lit("b"), "b")).withColumn("same", F.lit(1))
    # matched lines before a line: alike on both sides for the lines of one run
    gap = F.coalesce(F.sum("same").over(Window.partitionBy("pair_id", "side").orderBy("no")), F.lit(0))
    changed = table.join(same, ["pair_id", "side", "no"], "left").withColumn("gap", gap).filter("same is null")
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("no", "page", "text")))), lambda x: F.struct(x["page"].alias("page"), x["text"].alias("text"))).cast(LINES)
    runs = changed.groupBy("pair_id", "gap").agg(side("a").alias("removed"), side("b").alias("added"), F.min(F.when(F.col("side") == "a", F.col("no"))).alias("first"))
    # without removed lines, a run stands after the old line of its last match
    last = m.withColumn("gap", F.row_number().over(Window.partitionBy("pair_id").orderBy("a"))).select("pair_id", "gap", (F.col("a") + 1).alias("behind"))
    kind = F.when(F.size("removed") == 0, "insert").when(F.size("added") == 0, "delete").otherwise("replace")
    number = F.row_number().over(Window.partitionBy("pair_id").orderBy("gap")) - 1
    out = runs.join(last, ["pair_id", "gap"], "left").withColumns({"hunk": number, "kind": kind, "after": F.coalesce("first", "behind", F.lit(0))})
    return out.select("pair_id", "hunk", "kind", "after", "removed", "added")


def packets(changes: DataFrame, budget: int = DIFF_BUDGET, side_budget: int = SIDE_BUDGET, line_budget: int = LINE_BUDGET) -> DataFrame:
    """hunks() within the budgets, as JSON: pair_id, packet. Lines are cut to line_budget; a side stops before the line that would pass
    its budget, a packet before the change that would; the first line and the first change always stay."""

    def side(of: str) -> Column:
        texts = F.transform(of, lambda x: F.struct(x["page"].alias("page"), F.substring(x["text"], 1, line_budget).alias("text")))
        start = F.struct(F.lit(0).alias("used"), F.expr(f"cast(array() as {LINES})").alias("out"), F.lit(False).alias("full"))

        def step(a: Column, x: Column) -> Column:
            full = a["full"] | ((F.size(a["out"]) > 0) & (a["used"] + F.length(x["text"]) > side_budget))
            return F.struct(F.when(full, a["used"]).otherwise(a["used"] + F.length(x["text"])).alias("used"), F.when(full, a["out"]).otherwise(F.concat(a["out"], F.array(x))).cast(LINES).alias("out"), full.alias("full"))

        return F.aggregate(texts, start, step, lambda a: a["out"])

    body = F.to_json(F.struct("kind", side("removed").alias("previous"), side("added").alias("current")))
    own = Window.partitionBy("pair_id").orderBy("hunk")
    sized = changes.select("pair_id", "hunk", body.alias("body")).withColumn("upto", F.sum(F.length("body")).over(own)).filter((F.col("hunk") == 0) | (F.col("upto") <= budget))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk", "body"))), lambda x: x["body"]), ",")
    return sized.groupBy("pair_id").agg(F.concat(F.lit('{"changes":['), listed, F.lit("]}")).alias("packet"))
