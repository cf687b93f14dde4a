"""Secret scans with a randomness test battery; DataFrame and SQL functions only.

Base rules find assigned credentials, access keys and hex runs. Besides, every long run of encoding characters is a
candidate, without the parts that base rules found. Its encoding (hex, base32, base36, base62, base64) is inferred from its alphabet, and it is tested under
that encoding: chi-squared uniformity of the alphabet, Wald-Wolfowitz runs about the alphabet's middle, and lag-1
serial correlation. A candidate counts as random if none of the three rejects randomness (Bonferroni). The tests have
little power against short strings, so that isn't enough: the same three must also reject the hypothesis "text", under
which symbols repeat as often as letters do (uniformity), the class of characters (lower, upper, digit) seldom changes
(runs), and neighbours are mostly of one class (serial correlation); separators and the capitals of words aren't changes.
Fisher's method combines the three p-values, and false discoveries are controlled over the combined one
(Benjamini-Hochberg) within each class of length, from a histogram over all candidates.

Limits: strings under LEAST characters (without padding) are no candidates; strings of one class are told from text by their repeats alone,
which takes some 60 characters; random ids (UUIDs, digests) are random and are found as well.

Defined results: null texts are empty and have no spans; positions are code points, ends exclusive; equal spans of
several kinds are all listed; repeated rows are scanned each (and count in the histogram each); an empty table gives
an empty result; extra columns stay in scan() unless they are named like its results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

#: The base rules. Kind, pattern, group whose length counts, least length; in this order.
RULES = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Cheap conditions that texts with a match fulfil.
HINTS = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA[A-Z0-9]", "hex": "[0-9a-f]{32}"}
#: Candidates of the method, and the least length of one.
CANDIDATE, LEAST = r"[A-Za-z0-9+/_=-]{20,}", 20
#: Encodings by alphabet, the narrowest first.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "^[0-9A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64url", "^[0-9A-Za-z_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Level of the battery, and rate of false discoveries.
ALPHA, FDR = 1e-3, 1e-2
#: Text: how often two of its characters are the same one, how often its class changes, and the correlation of neighbours' classes.
TEXT_REPEATS, TEXT_CHANGES, TEXT_SERIAL = 0.06, 0.1, 0.3
#: p-values are counted in steps of 1/8 decade, down to 1e-40.
STEPS, DEEPEST = 8, 320
SPAN = "struct<start:bigint,stop:bigint,kind:string>"


def _matches(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, stop, hit, part>>: leftmost non-overlapping matches; part is the group."""
    hits, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    found = F.arrays_zip(hits.alias("hit"), parts.alias("part"), gaps.alias("gap"))  # one more gap than hits
    kind = "array<struct<start:bigint,stop:bigint,hit:string,part:string>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {kind})").alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        end = begin + F.length(x["hit"]).cast("long")
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("stop"), x["hit"].alias("hit"), x["part"].alias("part")))).cast(kind).alias("out"))

    return F.aggregate(F.filter(found, lambda x: x["hit"].isNotNull()), start, step, lambda a: a["out"])


def _base(text: Column) -> Column:
    """Base spans by start, then in the order of RULES."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(RULES):
        spans = F.transform(F.filter(_matches(text, pattern, group), lambda m: F.length(m["part"]) >= least), lambda m: F.struct(m["start"], F.lit(order).alias("rank"), m["stop"].alias("stop"), F.lit(kind).alias("kind")))
        none = F.expr("cast(array() as array<struct<start:bigint,rank:int,stop:bigint,kind:string>>)")
        found.append(F.when(text.rlike(HINTS[kind]), spans).otherwise(none))
    return F.transform(F.array_sort(F.concat(*found)), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))


def _outside(m: Column) -> Column:
    """array<struct<start, stop, hit>>: what base spans leave of a match, without parts that are too short."""
    kind = "array<struct<start:bigint,stop:bigint,hit:string>>"
    over = F.filter("base", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"]))

    def part(a: Column, stop: Column) -> Column:
        hit = F.substring(m["hit"], (a["at"] - m["start"] + 1).cast("int"), (stop - a["at"]).cast("int"))
        one = F.array(F.struct(a["at"].alias("start"), stop.alias("stop"), hit.alias("hit")))
        return F.when(stop - a["at"] >= LEAST, F.concat(a["out"], one)).otherwise(a["out"]).cast(kind)

    step = lambda a, b: F.struct(F.greatest(a["at"], b["stop"]).alias("at"), part(a, b["start"]).alias("out"))
    return F.aggregate(over, F.struct(m["start"].alias("at"), F.expr(f"cast(array() as {kind})").alias("out")), step, lambda a: part(a, m["stop"]))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution: rational approximation times the density, good in relative terms far out."""

    def tail(v: Column) -> Column:
        poly = v["t"] * (0.319381530 + v["t"] * (-0.356563782 + v["t"] * (1.781477937 + v["t"] * (-1.821255978 + v["t"] * 1.330274429))))
        one = F.exp(-v["z"] * v["z"] / 2) * 0.3989422804014327 * poly
        return F.when(v["z"] >= 0, one).otherwise(1 - one)

    return _let(z, lambda z: _let(F.struct(z.alias("z"), (1 / (1 + 0.2316419 * F.abs(z))).alias("t")), tail))


def battery(token: Column) -> Column:
    """struct<encoding, n, p_uniform, p_runs, p_serial, p_text> of a string of encoding characters."""
    encoding, alphabet = F.lit(ENCODINGS[-1][0]), F.lit(ENCODINGS[-1][2])
    for name, pattern, letters in ENCODINGS[-2::-1]:
        encoding = F.when(token.rlike(pattern), name).otherwise(encoding)
        alphabet = F.when(token.rlike(pattern), letters).otherwise(alphabet)
    body = F.rtrim(token, F.lit("="))
    # capitals of words count as lower case, separators not at all
    cased = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "[^A-Za-z0-9]", ""), "[A-Z](?=[a-z])", "a"), "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "c")
    base = F.transform(F.array(F.struct(encoding.alias("e"), alphabet.alias("a"), body.alias("b"), cased.alias("c"))), lambda r: F.struct(r["e"].alias("e"), F.length(r["a"]).cast("double").alias("k"), F.transform(F.split(r["b"], ""), lambda c: (F.instr(r["a"], c) - 1).cast("double")).alias("x"), F.transform(F.split(r["c"], ""), lambda c: F.instr(F.lit("abc"), c).cast("double")).alias("c")))
    pairs = lambda a: F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def serial(x: Column) -> Column:
        """Lag-1 correlation; null if all are equal."""
        about = _let(F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x), lambda m: F.transform(x, lambda v: v - m))
        sums = lambda y: F.struct(F.aggregate(pairs(y), F.lit(0.0), lambda a, v: a + v["p"] * v["q"]).alias("both"), F.aggregate(y, F.lit(0.0), lambda a, v: a + v * v).alias("own"))
        return _let(_let(about, sums), lambda s: F.when(s["own"] > 1e-9, s["both"] / s["own"]))

    def counts(r: Column) -> Column:
        """What the tests need of a string: its symbols counted once."""
        high = F.transform(r["x"], lambda v: v * 2 >= r["k"])
        return F.struct(
            r["e"].alias("e"), r["k"].alias("k"), F.size(r["x"]).cast("double").alias("n"),
            F.aggregate(F.array_distinct(r["x"]), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter(r["x"], lambda y: y == v)).cast("double"), 2)).alias("squares"),
            _let(high, lambda h: F.struct(F.size(F.filter(h, lambda b: b)).cast("double").alias("n1"), (1 + F.size(F.filter(pairs(h), lambda v: v["p"] != v["q"]))).alias("runs"))).alias("high"),
            serial(r["x"]).alias("serial"), F.size(r["c"]).cast("double").alias("m"), F.size(F.filter(pairs(r["c"]), lambda v: v["p"] != v["q"])).alias("changes"), serial(r["c"]).alias("classes"),
        )

    def tests(r: Column) -> Column:
        k, n, m, squares = r["k"], r["n"], r["m"], r["squares"]
        df = k - 1
        chi = F.greatest(k / n * squares - n, F.lit(1e-9))
        z_uniform = (F.pow(chi / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))  # Wilson-Hilferty
        mean = 1 + 2 * r["high"]["n1"] * (n - r["high"]["n1"]) / n
        z_runs = _let(mean, lambda mean: F.abs(r["high"]["runs"] - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))))
        z_serial = F.abs(F.coalesce(r["serial"], F.lit(1.0)) + 1 / n) * F.sqrt(n)
        # the same statistics under the hypothesis "text"
        t_uniform = _upper_tail(2 * (F.sqrt(TEXT_REPEATS * n * (n - 1) / 2) - F.sqrt((squares - n) / 2 + 0.375)))  # Anscombe, lower tail
        t_runs = F.when(m > 1, _upper_tail((r["changes"] - 0.5 - (m - 1) * TEXT_CHANGES) / F.sqrt((m - 1) * TEXT_CHANGES * (1 - TEXT_CHANGES)))).otherwise(1.0)
        t_serial = F.coalesce(_upper_tail((TEXT_SERIAL - r["classes"]) * F.sqrt(m)), F.lit(1.0))
        log = lambda p: F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300)))
        fisher = _let(-(log(t_uniform) + log(t_runs) + log(t_serial)), lambda half: F.exp(-half) * (1 + half + half * half / 2))
        return F.struct(
            r["e"].alias("encoding"), n.cast("int").alias("n"), _upper_tail(z_uniform).alias("p_uniform"), (2 * _upper_tail(z_runs)).alias("p_runs"),
            (2 * _upper_tail(z_serial)).alias("p_serial"), fisher.alias("p_text"),
        )

    return F.transform(F.transform(base, counts), tests)[0]


def _length_class(n: Column) -> Column:
    return F.least(F.floor(F.log2(n.cast("double"))), F.lit(12)).cast("int")


def _step(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * STEPS), F.lit(DEEPEST)).cast("int")


def _thresholds(scanned: DataFrame) -> DataFrame:
    """length class -> the least step of p-values that is a discovery (Benjamini-Hochberg over the histogram)."""
    each = scanned.select(F.explode("candidates").alias("c")).select(_length_class(F.col("c.n")).alias("length"), _step(F.col("c.p_text")).alias("step"))
    hist = each.groupBy("length", "step").count()
    own = Window.partitionBy("length")
    hist = hist.withColumns({"all": F.sum("count").over(own), "upto": F.sum("count").over(own.orderBy(F.desc("step")))})
    # every p-value of a step is at most 10^(-step / STEPS)
    return hist.filter(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= FDR * F.col("upto") / F.col("all")).groupBy("length").agg(F.min("step").alias("step"))


def scan(docs: DataFrame) -> DataFrame:
    """docs with base and spans: array<struct<start, stop, kind>>, sorted; spans has those of the method too. Columns of
    docs that are named base, spans, candidates or limits are replaced (shielded() keeps them apart)."""
    docs = docs.drop("base", "spans", "candidates", "limits")
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumn("base", _base(text))
    some = F.flatten(F.transform(_matches(text, CANDIDATE, 0), _outside))
    some = F.filter(some, lambda m: F.length(F.rtrim(m["hit"], F.lit("="))) >= LEAST)
    tested = F.transform(some, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), battery(m["hit"]).alias("t")))
    random = lambda t: F.least(t["p_uniform"], t["p_runs"], t["p_serial"]) * 3 >= ALPHA
    flat = F.transform(tested, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["t"]["n"].alias("n"), m["t"]["p_text"].alias("p_text"), random(m["t"]).alias("random")))
    none = F.expr("cast(array() as array<struct<start:bigint,stop:bigint,n:int,p_text:double,random:boolean>>)")
    scanned = docs.withColumn("candidates", F.when(text.rlike(CANDIDATE), flat).otherwise(none))
    limits = cut(_thresholds(scanned.select("candidates")))  # a row per length class: 13 at most
    bound = F.broadcast(limits.agg(F.map_from_entries(F.collect_list(F.struct("length", "step"))).alias("limits")))
    new = F.filter("candidates", lambda c: c["random"] & F.coalesce(_step(c["p_text"]) >= F.col("limits")[_length_class(c["n"])], F.lit(False)))
    more = F.transform(new, lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), F.lit("random").alias("kind")))
    rank = F.create_map(*[F.lit(v) for k, (kind, *_) in enumerate((*RULES, ("random",))) for v in (kind, k)])
    keyed = F.transform(F.concat("base", more), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return scanned.crossJoin(bound).withColumn("spans", spans).drop("candidates", "limits")


def redact(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """scan()'s rows with each maximal run of overlapping spans in text replaced by mark; base and spans go."""
    text = F.col("text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, s: Column) -> Column:
        new = s["start"] >= a["at"]
        gap = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.struct(F.when(new, F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["stop"]).alias("at"))

    ends = lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))
    done = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, ends)).otherwise(text)
    return scanned.withColumn("text", done).drop("base", "spans")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k, *_ in RULES), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
