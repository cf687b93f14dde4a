"""The engine's own queries over the driver's tables, and their DuckDB SQL.

Each applies an operator to whole tables that stand in for the corpus's own ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names, numbers, sequential, text
from .operators import aggregates, filters, joins, ranking, selection, sets, windows
from .sources import markup
from .streaming import queries as streams
from .tables import read

K = 8
#: The wide net that diverse passages are picked from, and the least score of one.
NET, FLOOR = 50, 0.30
#: Fixed value: the name words that the name queries add salts to, so that salt rules show.
SALT_OF = ("sodium", "hydrochloride", "sulfate")


def _r(c: str | Column, places: int = 6) -> Column:
    return F.round(c, places)


def _asked(vectors: DataFrame, vec_id: int = 0) -> list[float]:
    """One vector: a query, not a table."""
    row = vectors.filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]] if row and row[0] else []


# --- retrieval ---------------------------------------------------------------------------------------------------------


def vector_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    return ranking.top_k(v, _asked(v), K, id_="vec_id").select("vec_id", _r("distance").alias("distance"), _r("score").alias("score"))


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    where = filters.compile_filter({"label": {"$in": [1, 2, 3]}}, {"label": "int"})
    return ranking.top_k(v, _asked(v), K, where, "vec_id").select("vec_id", "label", _r("score").alias("score"))


def _batch(spark: SparkSession, sf_dir: str, least: int = 50, k: int = K) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    asked = v.filter(F.col("vec_id") % least == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return ranking.top_k_each(v, asked, k, "vec_id")


def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"), _r("score").alias("score"))


TOPK_BATCH_SQL = """
with q as (select vec_id query_id, embedding::double[] q from embeddings where vec_id % 50 = 0),
d as (select query_id, e.vec_id, 1 - list_cosine_similarity(e.embedding::double[], q) distance from embeddings e, q),
r as (select *, row_number() over (partition by query_id order by distance, vec_id) rank from d)
select query_id, vec_id, rank::int as rank, round(greatest(least(1 - distance / 2, 1), 0), 6) as score from r where rank <= 8"""


def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to K passages of each query's wide net above the floor, picked for diversity; a vector's text is that of the document of its id."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce("text", F.lit("")).alias("text"))
    pool = _batch(spark, sf_dir, k=NET).join(docs, "vec_id").select("query_id", F.col("rank").alias("position"), "vec_id", "score", "text")
    return ranking.trimmed(pool, K, FLOOR, True).select("query_id", "pick", "vec_id")


def retrieval_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours count as relevant when they carry the query's label."""
    v = read(spark, sf_dir, "embeddings")
    label = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"))
    hits = _batch(spark, sf_dir).filter("vec_id <> query_id").join(v.select("vec_id", "label"), "vec_id").join(label, "query_id")
    first = windows.first_match(hits, "query_id", F.col("label") == F.col("want"), F.col("rank"))
    return first.agg(F.count("*").alias("n"), _r(F.avg(F.col("rank").isNotNull().cast("double"))).alias("hit_rate"), _r(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))).alias("mrr"))


SCORECARD_SQL = """
with q as (select vec_id query_id, embedding::double[] q, label want from embeddings where vec_id % 50 = 0),
d as (select query_id, want, e.vec_id, label, 1 - list_cosine_similarity(e.embedding::double[], q) distance from embeddings e, q),
t as (select *, row_number() over (partition by query_id order by distance, vec_id) r from d),
h as (select *, row_number() over (partition by query_id order by r) rank from t where r <= 8 and vec_id <> query_id),
f as (select query_id, min(rank) filter (where label = want) as first_rank from h group by query_id)
select count(*) as n, round(avg(case when first_rank is null then 0.0 else 1.0 end), 6) as hit_rate, round(avg(coalesce(1.0 / first_rank, 0)), 6) as mrr from f"""


# --- corpus state ------------------------------------------------------------------------------------------------------


def coverage_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.coverage(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id", "source").drop("complete")


def coverage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.coverage(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")


def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.group_counts(read(spark, sf_dir, "documents"), "lang", "source")


def pending_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.pending(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), read(spark, sf_dir, "labels"), "doc_id")


def active_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.retired(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return joins.latest(orders, "o_custkey", "o_orderdate", "o_orderkey")


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.counted(read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "n_orders")


def dedup_losers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", numbers.content_hash(F.col("text")).alias("hash"))
    return windows.losers(docs, ["hash"], "doc_id", "doc_id").select("doc_id", "keeper")


def change_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's status against its customer's earlier ones, as a hash against a document's versions."""
    orders = read(spark, sf_dir, "orders")
    found = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_key"), F.lit("F").alias("content_hash"))
    versions = orders.select(F.col("o_custkey").alias("doc_key"), F.col("o_orderstatus").alias("content_hash"), F.col("o_orderdate").alias("captured_at"), F.col("o_orderkey").alias("version_id"))
    return sets.change_kinds(found, versions).select("doc_key", "kind")


CHANGE_SQL = """
with last as (select o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) s from orders group by 1),
old as (select distinct o_custkey from orders where o_orderstatus = 'F')
select c_custkey as doc_key, case when s is null then 'added' when s = 'F' then 'unchanged' when old.o_custkey is not null then 'error' else 'revised' end as kind
from customer left join last on c_custkey = last.o_custkey left join old on c_custkey = old.o_custkey"""


def shard_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(numbers.shard(F.col("doc_id").cast("string")).alias("shard"), "n_chars")
    return d.groupBy("shard").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest per shard, so that no task gathers all ids."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    d = d.withColumn("shard", numbers.shard(F.col("id")))
    return aggregates.digest(d, "id", "shard")


def _shard_sql(c: str) -> str:
    return f"(('0x' || substr(sha256(trim({c})), 13, 4))::int % 512)::int"


# --- logs and evaluation -----------------------------------------------------------------------------------------------


def metrics_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.counters(read(spark, sf_dir, "events"), "props", "$.k", "event_type")


def named_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    return aggregates.named_counters(read(spark, sf_dir, "events"), errors=e == "error", clicks=e == "click", large=F.col("value") > 50)


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    ranks = {"p50": selection.nearest_rank(0.5), "p95": selection.nearest_rank(0.95), **selection.MIDDLE}
    found = aggregates.with_statistics(e.groupBy("event_type").agg(F.max("value").alias("largest")), selection.order_statistics(e, "value", ["event_type"], ranks), ["event_type"])
    return found.select("event_type", "p50", "p95", _r((F.col("below") + F.col("above")) / 2).alias("median"), "largest")


def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = aggregates.distribution(read(spark, sf_dir, "events"), "value", "event_type")
    return d.withColumn("median", _r("median"))


def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.histogram(read(spark, sf_dir, "part"), "p_size")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "n_chars"), read(spark, sf_dir, "labels")
    size = F.least(F.col("n_chars") / 1000.0, F.lit(1.0))
    return labels.join(docs, "doc_id").select((F.col("quality") == 0).alias("must_refuse"), F.lit(False).alias("must_clarify"), size.alias("max_score"), (F.col("toxic") == 1).alias("refused"))


def _grid(spark: SparkSession) -> DataFrame:
    return spark.range(0, 21).select((F.col("id") / 20.0).alias("t"))


def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = aggregates.threshold_curve(_scored(spark, sf_dir), _grid(spark))
    return c.select("t", *(_r(x).alias(x) for x in ("refuse_recall", "answer_retention", "decision_accuracy")))


def threshold_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    return aggregates.recommended(rows, aggregates.threshold_curve(rows, _grid(spark)), 0.3)


CURVE_SQL = """
with s as (select quality = 0 as must_refuse, least(n_chars / 1000.0, 1.0)::double as max_score, toxic = 1 as refused from labels join documents using (doc_id)),
g as (select i / 20.0::double as t from range(21) r(i)),
m as (select t, must_refuse, case when max_score is null then refused else max_score < t end as no from s, g)
select t::double as t, round(coalesce(avg(no::int) filter (where must_refuse), 1), 6) as refuse_recall,
round(coalesce(avg((not no)::int) filter (where not must_refuse), 1), 6) as answer_retention, round(avg((must_refuse = no)::int), 6) as decision_accuracy from m group by t"""


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.confusion(read(spark, sf_dir, "labels"), "quality", "toxic")


# --- conversations -----------------------------------------------------------------------------------------------------


def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").withColumns({"pair": F.floor(F.col("turn") / 2), "status": F.lit(None).cast("string")})
    return windows.recent_turns(c, "conv_id", "pair", "role", "text", "status", [F.desc("turn")]).select("conv_id", "pair", F.col("position").cast("int").alias("position"), F.length("question").alias("question_chars"), F.length("answer").alias("answer_chars"))


TURNS_SQL = """
with m as (select *, turn // 2 as pair, row_number() over (partition by conv_id order by turn desc) n from conversations),
t as (select conv_id, pair, min(n) newest, arg_min(text, n) filter (where role = 'user') q, arg_min(text, n) filter (where role = 'assistant') a,
  count(*) filter (where role = 'user') u, count(*) filter (where role = 'assistant') b from m where n <= 24 group by 1, 2),
k as (select *, row_number() over (partition by conv_id order by newest) r from t where u > 0 and b > 0)
select conv_id, pair, (row_number() over (partition by conv_id order by newest desc))::int as position, length(trim(q, ' '))::int as question_chars, length(trim(a, ' '))::int as answer_chars from k where r <= 3"""


def display_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    sessions = c.select("conv_id").distinct().withColumn("title", F.lit(None).cast("string"))
    return joins.titled(sessions, c, "conv_id", "title", "role", "text", ["turn", "text"]).select("conv_id", "display_title")


def graph_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the sections of a document: FOLLOWS edges."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    return windows.follows(c, "conv_id", "turn", "turn")


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.sentences(F.col("text"))).alias("sentence"))
    return c.groupBy("conv_id", "turn").agg(F.count("*").alias("sentences"), F.max(F.length("sentence")).alias("longest"))


# --- text --------------------------------------------------------------------------------------------------------------


def _salted(part: DataFrame) -> DataFrame:
    salt = F.element_at(F.array(*map(F.lit, SALT_OF)), (F.col("p_partkey") % 3 + 1).cast("int"))
    return part.select("p_partkey", F.concat(F.col("p_name"), F.lit(" "), salt, F.lit(" (x) and "), F.upper("p_type")).alias("name"))


_SALTED_SQL = "select p_partkey, p_name || ' ' || ['sodium', 'hydrochloride', 'sulfate'][(p_partkey % 3 + 1)::int] || ' (x) and ' || upper(p_type) as name from part"
_PLAIN_SQL = r"list_transform(string_split(name, ' and '), lambda p: lower(trim(regexp_replace(regexp_replace(p, '\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g'))))"


def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _salted(read(spark, sf_dir, "part")).select("p_partkey", names.canonical_name(F.col("name")).alias("canonical"))


def stripped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _salted(read(spark, sf_dir, "part")).select("p_partkey", names.stripped_name(F.col("name")).alias("stripped"))


def app_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.element_at(F.array(*map(F.lit, ("N", "ANDA-", "BLA ", ""))), (F.col("s_suppkey") % 4 + 1).cast("int")), F.lpad(F.col("s_suppkey").cast("string"), 5, "0"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", names.application_number(raw).alias("number"))


def unpivot_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of parts as JSON objects, some of them malformed, through the operator that reads requirements."""
    from .plans import corpus

    p = read(spark, sf_dir, "part")
    payload = F.to_json(F.struct("p_name", "p_brand", "p_type", F.lit(" ").alias("blank"), F.lit("x").alias("unlabelled")))
    rows = p.select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 10 == 9, F.concat(F.lit("x"), payload)).otherwise(payload).alias("fields_json"))
    labels = spark.createDataFrame([(f, f.removeprefix("p_").title()) for f in ("p_name", "p_brand", "p_type", "blank")], "field string, label string")
    return corpus.unpivoted(rows, labels).select(F.col("doc_id").alias("p_partkey"), "field", "label", "value")


def entity_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salted listings against the plain products of the same words."""
    part = read(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    products = part.select(F.col("p_name").alias("name")).distinct().select(F.col("name").alias("product_id"), "name", none.alias("route"), none.alias("dosage_form"))
    salt = F.element_at(F.array(*map(F.lit, SALT_OF)), (F.col("p_partkey") % 3 + 1).cast("int"))
    asked = part.select(F.col("p_partkey").alias("listing_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" "), salt)).alias("name"), none.alias("route"), none.alias("dosage_form"))
    return joins.cascade(asked, products)


def misspelt_catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Listings and products of parts, whose routes and forms may differ. Listings carry a salt, an unknown ingredient besides, or
    a name (of two words or, for products of combinations, more) that lacks or repeats a letter at any place."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), "p_type", "p_brand")
    pick = lambda k, n: F.when(k % n == 0, None).when(k % n == 1, "oral").otherwise("oral solution")
    form = lambda k, n: F.when(k % n == 0, None).otherwise(F.lower("p_type"))
    each = part.groupBy("name").agg(F.min("k").alias("k"), F.min("p_type").alias("p_type"), F.min("p_brand").alias("p_brand"))
    long = each.withColumn("name", F.concat("name", F.lit("; "), F.lower("p_type"), F.lit(" "), F.lower("p_brand")))
    products = each.unionByName(long).select(F.col("name").alias("product_id"), "name", pick(F.col("k"), 4).alias("route"), form(F.col("k"), 3).alias("dosage_form"))
    base = F.when(F.col("k") % 2 == 0, F.col("name")).otherwise(F.concat("name", F.lit("; "), F.lower("p_type"), F.lit(" "), F.lower("p_brand")))
    at = (F.col("k") % F.length("base") + 1).cast("int")
    head, tail = F.substring(F.col("base"), F.lit(1), at - 1), F.substring(F.col("base"), at, F.length("base"))
    asked = F.when(F.col("k") % 5 == 0, F.concat("base", F.lit(" sodium"))).when(F.col("k") % 5 == 1, F.concat("base", F.lit(" and zzz"))).when(F.col("k") % 5 == 2, F.concat(head, F.substring(tail, 2, 1000)))
    asked = asked.when(F.col("k") % 5 == 3, F.concat(head, F.substring(tail, 1, 1), tail)).otherwise(F.substring(F.col("base"), 2, 1000))
    listings = part.withColumn("base", base).select(F.col("k").alias("listing_id"), asked.alias("name"), pick(F.col("k"), 7).alias("route"), form(F.col("k"), 2).alias("dosage_form"))
    return listings, products


def entity_cascade_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, gated by route and form."""
    return joins.cascade(*misspelt_catalogue(spark, sf_dir)).withColumn("confidence", _r("confidence"))


CASCADE_SQL = """select p_partkey as listing_id, p_name as product_id, case when p_partkey % 2 = 0 then 1.0 else 0.92 end::double as confidence,
case when p_partkey % 2 = 0 then 'canonical' else 'stripped' end as rationale from part"""


def redundancy_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest overlap of two turns of a conversation."""
    from .plans import retrieval

    return retrieval.redundancy(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn").withColumn("redundancy", _r("redundancy"))


REDUNDANCY_SQL = """
with w as (select conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: length(x) > 2)) t from conversations),
p as (select a.conv_id, case when len(a.t) = 0 or len(b.t) = 0 then 0.0 else len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) end as j
  from w a join w b on a.conv_id = b.conv_id and a.turn < b.turn)
select conv_id, round(coalesce(max(j), 0.0), 6) as redundancy, coalesce(max(j), 0.0) >= 0.6 as redundant from (select distinct conv_id from conversations) left join p using (conv_id) group by conv_id"""


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.retrieval import chunked

    d = read(spark, sf_dir, "documents").select("doc_id", F.array(F.coalesce("text", F.lit(""))).alias("pages"))
    return chunked(d).select("doc_id", "ordinal", "page", F.length("text").alias("chars"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that occur in several documents, with the number of those."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    n = d.groupBy("line").agg(F.count("*").alias("documents"))
    return n.filter("documents > 1 and line <> ''").select(F.md5("line").alias("line_md5"), "documents")


def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.visible(read(spark, sf_dir, "pages").select("page_id", "html"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", numbers.content_hash(c).alias("hash"), numbers.token_estimate(c).alias("tokens"))


def limit_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities against limits written as text."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    said = F.when(n % 3 == 0, "NMT 25.0%").when(n % 3 == 1, "NLT 10.5").otherwise("12 - 40")
    ok = numbers.satisfies(numbers.measured(q.cast("string")), numbers.limit(said))
    return read(spark, sf_dir, "lineitem").select("l_returnflag", ok.alias("ok")).groupBy("l_returnflag").agg(F.count_if("ok").alias("met"), F.count_if(~F.col("ok")).alias("violated"))


# --- event streams -----------------------------------------------------------------------------------------------------


def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.calls_within(read(spark, sf_dir, "events"), "user_id", "ts", 3600).select("event_id", "calls")


def rate_limit_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.rate_limited(read(spark, sf_dir, "events"), "user_id", 2, 3600.0)


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = streams.tumbling(read(spark, sf_dir, "events"), "1 hour", "1 hour", "event_type")
    return n.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = streams.sessions(read(spark, sf_dir, "events"), "user_id", "30 minutes")
    return n.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


SESSIONS_SQL = """
with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) k from g)
select user_id, min(ts) as session_start, count(*) as n from s group by user_id, k"""

QUERIES = {
    f.__name__: f
    for f in (
        vector_topk_exact, vector_topk_filtered, vector_topk_batch, mmr_select, retrieval_scorecard, coverage_by_group, coverage_total, group_counts, pending_page, active_reconcile,
        latest_version, customer_orders, dedup_losers, change_kind, shard_rollup, corpus_digest, metrics_counters, named_counters, latency_percentiles, score_distribution, value_histogram,
        threshold_curve, threshold_recommend, confusion_matrix, recent_turns, display_title, graph_follows, sentence_stats, canonical_names, stripped_names, app_numbers, unpivot_fields,
        entity_cascade, entity_cascade_fuzzy, redundancy_max, chunk_documents, repeated_lines, html_visible_text, content_hashes, limit_oracle, rate_limit_window, rate_limit_exact, tumbling_counts, session_counts,
    )
}

_DISTANCE = "1 - list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0))"
_SCORE = "round(greatest(least(1 - d / 2, 1), 0), 6) as score"
_STRIPPED = f"list_transform({_PLAIN_SQL}, lambda p: array_to_string(list_filter(string_split(p, ' '), lambda w: w not in ('sodium', 'hydrochloride', 'sulfate')), ' '))"

SENTENCES_SQL = r"""
with p as (select conv_id, turn, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\S')) as ps from conversations),
e as (select conv_id, turn, unnest(range(1, len(ps) + 1)) as i, ps from p),
w as (select conv_id, turn, i, ps[i] as s, lower(regexp_extract(ps[i - 1], '([A-Za-z][A-Za-z.]*)\.$', 1)) as w from e),
c as (select *, i > 1 and case when w = 'ph' then starts_with(lower(s), 'eur') else contains(w, '.') or w in
  ('e.g', 'i.e', 'cf', 'vs', 'approx', 'no', 'fig', 'figs', 'sec', 'secs', 'tbl', 'ref', 'refs', 'eq', 'ca', 'dr', 'mr', 'mrs', 'ms', 'prof') end as goes_on from w),
g as (select *, sum(case when goes_on then 0 else 1 end) over (partition by conv_id, turn order by i) as g from c),
n as (select conv_id, turn, g, sum(len(s)) + count(*) - 1 as chars from g group by 1, 2, 3)
select conv_id, turn, count(*) as sentences, max(chars)::int as longest from n group by 1, 2"""

#: Queries without SQL here are sequential algorithms; tests hold them against plain Python.
SQL = {
    "vector_topk_exact": f"select vec_id, round(d, 6) as distance, {_SCORE} from (select vec_id, {_DISTANCE} d from embeddings) order by d, vec_id limit 8",
    "vector_topk_filtered": f"select vec_id, label, {_SCORE} from (select vec_id, label, {_DISTANCE} d from embeddings where label in (1, 2, 3)) order by d, vec_id limit 8",
    "vector_topk_batch": TOPK_BATCH_SQL,
    "retrieval_scorecard": SCORECARD_SQL,
    "coverage_by_group": "select source, count(*) as expected, count(l.doc_id) as embedded, count(*) - count(l.doc_id) as pending, round(100.0 * count(l.doc_id) / count(*), 2) as percent from documents d left join (select distinct doc_id from labels) l using (doc_id) group by source",
    "coverage_total": "select count(*) as expected, count(l.doc_id) as embedded, greatest(count(*) - count(l.doc_id), 0) as pending, round(100.0 * count(l.doc_id) / count(*), 2) as percent, count(*) > 0 and count(*) = count(l.doc_id) as complete from documents d left join (select distinct doc_id from labels) l using (doc_id)",
    "group_counts": "select coalesce(nullif(lang, ''), '<missing>') as key, count(distinct source) as documents, count(*) as chunks from documents group by 1",
    "pending_page": "select doc_id, lang, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id) order by doc_id",
    "active_reconcile": "select doc_id from documents except select doc_id from labels",
    "latest_version": "select o_custkey, o_orderkey, o_orderdate, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
    "customer_orders": "select c_custkey, count(o_orderkey) as n_orders from customer left join orders on c_custkey = o_custkey group by c_custkey",
    "dedup_losers": "select doc_id, keeper from (select doc_id, max(doc_id) over (partition by text) keeper from documents where text is not null) where doc_id <> keeper",
    "change_kind": CHANGE_SQL,
    "shard_rollup": f"select {_shard_sql('doc_id::varchar')} as shard, count(*) as n, sum(n_chars)::bigint as chars from documents group by 1",
    "corpus_digest": f"select {_shard_sql('doc_id::varchar')} as shard, md5(string_agg(doc_id::varchar, ',' order by doc_id::varchar)) as digest from documents group by 1",
    "metrics_counters": "select event_type, json_extract_string(props, '$.k') as value, count(*) as n from events group by 1, 2",
    "named_counters": "select unnest(['errors', 'clicks', 'large']) as name, unnest([count(*) filter (where event_type = 'error'), count(*) filter (where event_type = 'click'), count(*) filter (where value > 50)]) as n from events",
    "latency_percentiles": "select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, round(median(value), 6) as median, max(value) as largest from events group by 1",
    "score_distribution": "select event_type, count(*) as n, count(value) as n_scored, min(value) as min, round(median(value), 6) as median, max(value) as max from events group by 1",
    "value_histogram": "select p_size as key, count(*) as n from part group by 1",
    "threshold_curve": CURVE_SQL,
    "confusion_matrix": "select quality, toxic, count(*) as n from labels group by 1, 2",
    "recent_turns": TURNS_SQL,
    "display_title": "select conv_id, arg_min(text, turn) filter (where role = 'user') as display_title from conversations group by conv_id",
    "graph_follows": "select * from (select conv_id, turn as src, lead(turn) over (partition by conv_id order by turn) as dst from (select distinct conv_id, turn from conversations)) where dst is not null",
    "canonical_names": f"select p_partkey, array_to_string(list_sort({_PLAIN_SQL}), '; ') as canonical from ({_SALTED_SQL})",
    "stripped_names": f"select p_partkey, array_to_string(list_sort({_STRIPPED}), '; ') as stripped from ({_SALTED_SQL})",
    "app_numbers": "select s_suppkey, ['NDA', 'ANDA', 'BLA', ''][(s_suppkey % 4 + 1)::int] || lpad(s_suppkey::varchar, 6, '0') as number from supplier",
    "sentence_stats": SENTENCES_SQL,
    "unpivot_fields": "select p_partkey, field, upper(field[3]) || field[4:] as label, value from (unpivot (select p_partkey, p_name, p_brand, p_type from part) on p_name, p_brand, p_type into name field value value) where value <> '' and p_partkey % 10 <> 9",
    "entity_cascade": CASCADE_SQL,
    "redundancy_max": REDUNDANCY_SQL,
    "repeated_lines": "select md5(line) as line_md5, count(*) as documents from (select distinct doc_id, unnest(string_split(text, chr(10))) as line from documents) where line <> '' group by line having count(*) > 1",
    "content_hashes": "select doc_id, sha256(text) as hash, ceil(length(text) / 4.0)::bigint as tokens from documents",
    "limit_oracle": "select l_returnflag, count(*) filter (where ok) as met, count(*) filter (where not ok) as violated from (select l_returnflag, case l_linenumber % 3 when 0 then l_quantity <= 25 when 1 then l_quantity >= 10.5 else l_quantity between 12 and 40 end as ok from lineitem) group by 1",
    "rate_limit_window": "select event_id, count(*) over (partition by user_id order by ts range between interval 3600 seconds preceding and current row) as calls from events",
    "tumbling_counts": "select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n from events group by 1, 2",
    "session_counts": SESSIONS_SQL,
}
