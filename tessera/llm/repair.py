"""Repair of the structure of conversations, solved once for each distinct signature.

Every row of a conversation is one letter: its role's initial (s, u, a, or x for another one), small for a sound row and
large for a truncated one; 0 to 3 in the same order for rows that must go (blank, duplicate). A conversation's signature
is the string of its letters in order, built by tasks over ranges of (conversation, turn), so that a long conversation is spread. The
cheapest edits of each distinct signature are found once, by recursion over (row, expected role) with a memory. Audits are
joined back by signature, and replayed over the rows in order: rows stream past one conversation's audit (a byte a row).

Edits turn roles into an optional system row and then pairs of user and assistant: Keep 0, Rerole 2, Insert an empty row 2,
Delete 3; a truncated row that stays adds 1. Of the cheapest, the audit that is least in ASCII wins.

Defined results: rows of one conversation are in order of turn (nulls first), then role, then text digest; a null role or
text is one space; null conv_ids are one conversation; equal rows are duplicates of each other whatever their turns;
conversations without rows have zeros, an empty audit and the digest of nothing; an empty table gives an empty result; other
columns are ignored; texts may have any length. A repaired text's digest needs its rows one after another, so the last
step streams each conversation through one task; it holds one row at a time and the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, lookup, read

BLANKS = " \t\n\x0b\x0c\r"
SMALL, LARGE, GONE = "suax", "SUAX", "0123"
REROLE, INSERT, DELETE, TRUNCATED = 2, 2, 3, 1
NAMES = {"u": "user", "a": "assistant"}
#: What may stand next, by what stands before (nothing, s, u, a), as the place in this string that it leads to.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
#: What a rerole or an insert puts there.
PUT = {0: "u", 1: "u", 2: "a", 3: "u"}
#: Letters that are solved at a time, so that neither recursion nor memory grow with a conversation; pieces remembered per worker.
STRIDE, REMEMBERED = 100, 4096


@lru_cache(REMEMBERED)
def piece(letters: str, after: tuple[int, ...] | None) -> tuple[tuple[int, str, int], ...]:
    """For each state before letters: (cost of the rest, audit within letters, state behind them). after: the costs of what
    follows by state; None at the end of a conversation."""
    n = len(letters)

    @cache
    def best(i: int, state: int, inserts: int) -> tuple[float, str]:
        """(cost of the rest, first edit) from row i on; more than two inserts in a row never pay."""
        if i == n and after is not None:
            return after[state], ""
        options: list[tuple[float, str]] = [(0, "")] if i == n and state in ENDS else []
        if inserts < 2:
            options.append((INSERT + best(i, NEXT[state][PUT[state]], inserts + 1)[0], "I"))
        if i < n:
            letter = letters[i]
            options.append((DELETE + best(i + 1, state, 0)[0], "D"))
            if letter not in GONE:
                more = TRUNCATED if letter in LARGE else 0
                options.append((REROLE + more + best(i + 1, NEXT[state][PUT[state]], 0)[0], "R"))
                if letter.lower() in NEXT[state]:
                    options.append((more + best(i + 1, NEXT[state][letter.lower()], 0)[0], "K"))
        return min(options, default=(float("inf"), ""))

    def walk(state: int) -> tuple[int, str, int]:
        cost, audit, i, inserts = int(best(0, state, 0)[0]), [], 0, 0
        while edit := best(i, state, inserts)[1]:
            audit.append(edit)
            if edit == "K":
                state = NEXT[state][letters[i].lower()]
            elif edit != "D":
                state = NEXT[state][PUT[state]]
            i, inserts = (i, inserts + 1) if edit == "I" else (i + 1, 0)
        return cost, "".join(audit), state

    return tuple(walk(state) for state in NEXT)


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits: pieces from the last to the first, then the audits from the first to the last."""
    starts = range(0, max(len(signature), 1), STRIDE)
    after, ends, base = None, [], 0
    for a in reversed(starts):
        ends.append(after)
        costs = [x[0] for x in piece(signature[a : a + STRIDE], after)]
        low = min(costs)
        after, base = tuple(c - low for c in costs), base + low
    cost, state, audit = base + after[0], 0, []
    for a, end in zip(starts, reversed(ends)):
        _, edits, state = piece(signature[a : a + STRIDE], end)[state]
        audit.append(edits)
    return cost, "".join(audit)


def illegal(signature: str) -> int:
    """Neighbours whose roles aren't su, ua or au."""
    roles = signature.translate(str.maketrans(GONE, SMALL)).lower()
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (0: dropped) by the checksum of conv_id:turn."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"))
    dice = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(dice == 1, "").when(dice == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.withColumns({"text": text, "role": F.when(dice == 4, "user").otherwise(F.col("role")), "copies": F.when(dice == 0, 0).when(dice == 3, 2).otherwise(1)})


def sound(conversations: DataFrame) -> DataFrame:
    """Undamaged rows in the form of damaged()."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), F.lit(1).alias("copies"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def letters(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copies) -> conv_id, turn, role, digest, with equal rows as one: blank, duplicate and truncated counts, and
    the letters that they give."""
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    each = rows.filter("copies > 0").select("conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), fault.alias("fault"), "copies")
    each = cut(each.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("m")))
    # the first turn of what is said more than once; the others are duplicates
    twice = cut(each.filter("fault <> 'blank'").groupBy("conv_id", "role", "digest").agg(F.count("*").alias("turns"), F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first")).filter("turns > 1"))
    twice = twice.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    twice = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    first = F.col("r").isNull() | F.col("turn").eqNullSafe(F.col("first.turn"))
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    letter = lambda of: F.substring(F.lit(of), place, F.lit(1))
    blank, m = F.col("fault") == "blank", F.col("m").cast("int")
    stays = F.when(~blank & first, 1).otherwise(0)
    out = each.join(twice, same, "left").withColumns({"stays": stays, "m": m})
    own = F.when(F.col("stays") == 0, "").when(F.col("fault") == "truncated", letter(LARGE)).otherwise(letter(SMALL))
    return out.select(
        "conv_id", "turn", "role", "digest", F.concat(own, F.repeat(letter(GONE), F.col("m") - F.col("stays"))).alias("letters"),
        F.when(blank, F.col("m")).otherwise(0).alias("blank"), F.when(~blank, F.col("m") - F.col("stays")).otherwise(0).alias("duplicate"),
        F.when(F.col("fault") == "truncated", F.col("stays")).otherwise(0).alias("truncated"),
    )


ORDER = ("conv_id", "turn", "role", "digest")


def signatures(marked: DataFrame) -> DataFrame:
    """letters() -> conv_id, signature: pieces of each range of the order, put together in the order of the ranges."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, held, out = TaskContext.get().partitionId(), None, [], []
        for batch in batches:
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and conv != now:
                    out.append((now, part, "".join(held)))
                    held = []
                now = conv
                held.append(text)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "part", "piece"), r)) for r in out], pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.string())]))
                out = []
        out += [(now, part, "".join(held))] if held else []
        yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "part", "piece"), r)) for r in out], pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.string())]))

    got = marked.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("conv_id", "letters").mapInArrow(pieces, "conv_id long, part int, piece string")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda p: p["piece"]), "")
    return got.groupBy("conv_id").agg(whole.alias("signature"))


def solved(signatures: DataFrame) -> DataFrame:
    """Distinct signatures -> signature, cost, audit, illegal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            cost, audit = zip(*map(solve, texts)) if texts else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cost, pa.int64()), pa.array(audit, pa.string()), pa.array([illegal(t) for t in texts], pa.int64())], names=["signature", "cost", "audit", "illegal"])

    return signatures.select("signature").distinct().mapInArrow(run, "signature string, cost long, audit string, illegal long")


def replayed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """rows in the form of damaged(), audits: conv_id, audit -> conv_id, repaired_sha256, for conversations with an audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
        now, edits, state, digest, written, out = None, iter(""), 0, None, 0, []

        def put(role: str, text: str) -> None:
            nonlocal written, state
            digest.update(f"{chr(10) if written else ''}{role}:{text}".encode())
            written, state = written + 1, NEXT[state][role[0]]

        def inserted() -> str:
            for edit in edits:
                if edit != "I":
                    return edit
                put(NAMES[PUT[state]], "")
            return ""

        for batch in batches:
            for conv, audit, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if audit is not None:  # first of its conversation
                    if digest is not None:
                        inserted()
                        out.append({"conv_id": now, "repaired_sha256": digest.hexdigest()})
                    now, edits, state, digest, written = conv, iter(audit), 0, hashlib.sha256(), 0
                    continue
                for _ in range(copies):
                    edit = inserted()
                    if edit != "D":
                        put(role if edit == "K" else NAMES[PUT[state]], text)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if digest is not None:
            inserted()
            out.append({"conv_id": now, "repaired_sha256": digest.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, schema)

    none = F.lit(None)
    first = audits.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("digest"), "audit", none.cast("string").alias("text"), F.lit(0).alias("copies"))
    then = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest(F.col("text")).alias("digest"), none.cast("string").alias("audit"), "text", "copies")
    both = first.unionByName(then).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return both.select("conv_id", "audit", "role", "text", "copies").mapInArrow(run, "conv_id long, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """rows in the form of damaged() or sound(): a row for each conversation, those without rows left included."""
    marked = cut(letters(rows))
    convs = cut(signatures(marked))
    audits = cut(solved(convs))
    found = cut(lookup(convs, audits, ["signature"], audits.count(), "inner", most=10_000).drop("signature"))
    counts = marked.groupBy("conv_id").agg(
        (F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)) - F.count_distinct("turn")).alias("gaps"),
        *(F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")),
    )
    every = rows.select("conv_id").distinct()
    on = lambda name: F.col("conv_id").eqNullSafe(F.col(name))
    told = found.withColumnRenamed("conv_id", "c1")
    counts = counts.withColumnRenamed("conv_id", "c2")
    sums = replayed(rows, found.select("conv_id", "audit")).withColumnRenamed("conv_id", "c3")
    out = every.join(counts, on("c2"), "left").join(told, on("c1"), "left").join(sums, on("c3"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(read(spark, sf_dir, "conversations")))


def _ahead(value: str, edit: str, cost: str) -> str:
    """SQL: edit before the audit in value, ten digits of cost and then an audit."""
    return f"lpad((substr({value}, 1, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || '{edit}' || substr({value}, 11)"


def _stay(edit: str, cost: str, goes: str) -> str:
    return f"CASE WHEN sound THEN {_ahead(goes, edit, cost)} END"


def _state(own: str, keep: str) -> str:
    """SQL: the least of deleting, reroling and keeping the row in a state; keep: (initial, value) pairs."""
    kept = "".join(f", CASE WHEN sound AND role[1] = '{c}' THEN {_ahead(v, 'K', 'cut')} END" for c, v in (x.split() for x in keep.split(",")))
    return f"least({_ahead(own, 'D', '3')}, {_stay('R', '2 + cut', 'v3' if own == 'v2' else 'v2')}{kept})"


OP13_SQL = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') AS ck,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
r AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 20 AS dice FROM c),
d AS (
  SELECT ck, turn, CASE WHEN dice = 4 THEN 'user' ELSE role END AS role,
         CASE dice WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE dice WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM r WHERE dice <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY turn NULLS FIRST, encode(role), sha256(text), copy) AS i FROM d),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY ck, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
         i > 1 AND lag(role[1]) OVER (PARTITION BY ck ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au') AS illegal FROM o),
g AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS sound, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS cut FROM f),
s AS (
  SELECT ck, max(i) + 1 AS i, '0000000002I' AS v2, '0000000000' AS v0, '0000000004II' AS v1, '0000000000' AS v3 FROM g GROUP BY ck
  UNION ALL
  SELECT ck, i, least(b2, {_ahead('b3', 'I', '2')}), least(b0, {_ahead('b2', 'I', '2')}, {_ahead('b3', 'II', '4')}),
         least(b1, {_ahead('b2', 'I', '2')}, {_ahead('b3', 'II', '4')}), least(b3, {_ahead('b2', 'I', '2')})
  FROM (SELECT g.ck, g.i, {_state('v0', 's v1,u v2')} AS b0, {_state('v1', 'u v2')} AS b1, {_state('v2', 'a v3')} AS b2, {_state('v3', 'u v2')} AS b3
        FROM s JOIN g ON g.ck = s.ck AND g.i = s.i - 1)),
a AS (SELECT ck, substr(v0, 1, 10)::BIGINT AS cost, substr(v0, 11) AS audit FROM s WHERE i = 1),
e AS (SELECT ck, p, audit[p] AS edit FROM (SELECT ck, audit, unnest(range(1, len(audit) + 1)) AS p FROM a)),
e2 AS (SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER w AS j FROM e WINDOW w AS (PARTITION BY ck ORDER BY p)),
e3 AS (
  SELECT e2.*, g.role, CASE WHEN edit = 'I' THEN '' ELSE g.text END AS text,
         max(CASE WHEN j = 1 AND edit = 'K' AND g.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e2.ck) AS led
  FROM e2 JOIN g ON e2.ck = g.ck AND greatest(e2.i, 1) = g.i WHERE edit <> 'D'),
t AS (
  SELECT ck, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS repaired_sha256
  FROM e3 GROUP BY ck),
n AS (
  SELECT ck, coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM g GROUP BY ck)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, ck FROM c) LEFT JOIN n USING (ck) LEFT JOIN a USING (ck) LEFT JOIN t USING (ck)
"""
