"""Relational joins of the corpus model: latest rows, pending work, fallbacks, entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, sequential, text
from ..tables import cut, small
from . import containment, spelling


def latest(rows: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The row of each key that is largest by order (columns, compared in turn; null is smallest)."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(top.alias("_top")).select(*keys, *(F.col(f"_top.{c}").alias(c) for c in rest))


def with_latest(left: DataFrame, rows: DataFrame, key: str, *order: str) -> DataFrame:
    """left with the latest row of its key, or nulls: a correlated top-1 subquery, as one aggregation and one join."""
    return left.join(latest(rows, key, *order), key, "left")


def pending(left: DataFrame, done: DataFrame, key: str, after: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows without a match in done, in order of key; after and limit page through them by key."""
    rows = left.join(done.select(key).distinct(), key, "left_anti")
    if after is not None:
        rows = rows.filter(F.col(key) > after)
    rows = rows.orderBy(key)
    return rows if limit is None else rows.limit(limit)


def chained_counts(documents: DataFrame, versions: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """doc_id, version_id, expected and embedded chunks: three outer joins under one aggregation."""
    return (
        documents.join(versions, "doc_id", "left").join(chunks, "version_id", "left").join(embeddings.select("chunk_id", F.lit(1).alias("_e")), "chunk_id", "left")
        .groupBy("doc_id", "version_id").agg(F.count("chunk_id").alias("expected"), F.count("_e").alias("embedded"))
    )


def counted(left: DataFrame, right: DataFrame, key: str, name: str = "n") -> DataFrame:
    """left with the number of matching rows (0 if none)."""
    return left.join(right.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def titled(sessions: DataFrame, messages: DataFrame, key: str, title: str, role: str, content: str, order: list[str]) -> DataFrame:
    """key and display_title: the session's own title, else its first user message."""
    first = messages.filter(F.col(role) == "user").groupBy(key).agg(F.min_by(content, F.struct(*order)).alias("_first"))
    return sessions.join(first, key, "left").select(*sessions.columns, F.coalesce(F.col(title), F.col("_first")).alias("display_title"))


def first_filled(left: DataFrame, version: DataFrame, document: DataFrame, version_key: str, document_key: str, column: str) -> DataFrame:
    """The version's value unless it is missing or empty, else the document's."""
    v = version.select(version_key, F.col(column).alias("_v"))
    d = document.select(document_key, F.col(column).alias("_d"))
    return left.join(v, version_key, "left").join(d, document_key, "left").select(*left.columns, F.coalesce(names.filled(F.col("_v")), F.col("_d")).alias(column))


def multi_valued(left: DataFrame, lookup: DataFrame, key: str, value: str, order: str, name: str) -> DataFrame:
    """left with the distinct values of its key in first-seen order (an empty array if none)."""
    first = lookup.groupBy(key, value).agg(F.min(order).alias("_o"))
    lists = first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias(name))
    return left.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def by_key(key: str | list[str], **tables: DataFrame) -> DataFrame:
    """A row per key of any table, with each table's rows as an array of structs in canonical order."""
    keys, out = [key] if isinstance(key, str) else key, None
    for name, t in tables.items():
        rest = [c for c in t.columns if c not in keys]
        rows = t.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
        out = rows if out is None else out.join(rows, keys, "full_outer")
    return out.select(*keys, *(F.coalesce(n, F.array()).alias(n) for n in tables))


def fallback(left: DataFrame, table: DataFrame, key: Column, parent: Column, value: str, most: int = 4) -> DataFrame:
    """left's parts (key: array of up to most exact keys, parent: their stripped ones) each with its value, and whether the
    parent's was taken."""
    parts = left.select(*left.columns, F.posexplode(F.slice(F.arrays_zip(key.alias("exact"), parent.alias("stripped")), 1, most)).alias("position", "_p"))
    a = table.select(F.col("key").alias("_ak"), F.col(value).alias("_av"))
    b = table.select(F.col("key").alias("_bk"), F.col(value).alias("_bv"))
    hit = parts.join(a, F.col("_p.exact") == F.col("_ak"), "left").join(b, (F.col("_p.stripped") == F.col("_bk")) & (F.col("_p.stripped") != ""), "left")
    return hit.select(*left.columns, "position", F.col("_p.exact").alias("part"), F.coalesce("_av", "_bv").alias(value), (F.col("_av").isNull() & F.col("_bv").isNotNull()).alias("from_parent"))


# --- entity resolution -------------------------------------------------------------------------------------------------

#: Confidences by stage, and the floor of the fuzzy one.
CANONICAL, STRIPPED, COMPONENT, FUZZY_FLOOR = 1.0, 0.92, 0.80, 92.0


def _keys(products: DataFrame) -> DataFrame:
    """product_id with each of its keys and the kind of key; none empty."""
    both = products.select("product_id", F.explode(F.array(F.struct(F.lit("canonical").alias("kind"), names.canonical_name(F.col("name")).alias("key")), F.struct(F.lit("stripped").alias("kind"), names.stripped_name(F.col("name")).alias("key")))).alias("k"))
    return both.select("product_id", "k.kind", "k.key").filter("key <> ''")


def cascade(listings: DataFrame, products: DataFrame, fuzzy: bool = True) -> DataFrame:
    """listings: listing_id, name, route, dosage_form; products: product_id and the same.
    Returns listing_id, product_id, confidence, rationale.

    Stages: canonical, stripped, component of a combination, fuzzy. A stage ends the search of a listing only if it gave a
    match that form and route allow. The exact stages are one equi join; only listings that none of them matched meet
    the product table in the fuzzy one. With it, what several stages read is written once: else every one of them works
    the names out again."""
    once = cut if fuzzy else lambda df: df
    products = once(products.select("product_id", "name", F.col("route").alias("_route"), F.col("dosage_form").alias("_form")))
    keys = once(_keys(products))
    name = F.col("name")
    asked = once(listings.select(
        "listing_id", "route", "dosage_form", names.canonical_name(name).alias("_canon"), names.stripped_name(name).alias("_own"),
        F.when(names.is_combination(name), names.component_keys(name)).otherwise(F.array().cast("array<string>")).alias("_parts"),
    ))
    kinds = [(1, "canonical", F.array("_canon")), (2, "stripped", F.array("_own")), (3, "combo_component", F.col("_parts"))]
    staged = lambda stage, why, own: F.transform(own, lambda k: F.struct(F.lit(stage).alias("stage"), F.lit(why).alias("rationale"), k.alias("key")))
    stages = F.explode(F.flatten(F.array(*(staged(*kind) for kind in kinds))))
    stages = asked.select("listing_id", "route", "dosage_form", stages.alias("_s")).select("listing_id", "route", "dosage_form", "_s.*")
    hits = stages.filter("key <> ''").join(keys, "key")
    # a hit on the product's stripped key dropped salt words on that side, so it isn't canonical
    why = F.when((F.col("stage") == 1) & (F.col("kind") == "stripped"), "stripped").otherwise(F.col("rationale"))
    sure = F.when(why == "canonical", CANONICAL).when(why == "stripped", STRIPPED).otherwise(COMPONENT)
    hits = hits.select("listing_id", "product_id", "stage", "route", "dosage_form", why.alias("rationale"), sure.alias("confidence"))
    hits = hits.groupBy("listing_id", "product_id", "stage", "route", "dosage_form").agg(F.max_by("rationale", "confidence").alias("rationale"), F.max("confidence").alias("confidence"))
    fits = lambda df: df.join(products, "product_id").filter(names.attributes_compatible(F.col("route"), F.col("_route")) & names.attributes_compatible(F.col("dosage_form"), F.col("_form")))
    hits = fits(hits)
    first = hits.withColumn("_first", F.min("stage").over(Window.partitionBy("listing_id"))).filter("stage = _first")
    out = once(first.select("listing_id", "product_id", "confidence", "rationale"))
    if not fuzzy:
        return out
    rest = cut(asked.join(out.select("listing_id").distinct(), "listing_id", "left_anti").filter("_own <> ''").select("listing_id", "route", "dosage_form", "_own"))
    near = similar(rest.select(F.col("_own").alias("text")), keys.select(F.col("key").alias("text")))
    scored = rest.join(near, F.col("_own") == F.col("left")).join(keys, F.col("right") == F.col("key"))
    best = scored.groupBy("listing_id", "product_id", "route", "dosage_form").agg(F.max("ratio").alias("ratio"))
    return out.unionByName(fits(best).select("listing_id", "product_id", (F.col("ratio") / 100).alias("confidence"), F.lit("fuzzy").alias("rationale")))


def similar(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, right: text. The distinct pairs left, right of texts whose token_sort_ratio is FUZZY_FLOOR or more, with ratio.

    The candidates are complete. Of texts of a and b characters (words sorted) with a common subsequence of 0.46 (a + b) or
    more, at most x = 4/27 a characters of the first are lost and y of the other are new; a lost one ends at most 3 of the
    first text's a + 2 padded trigrams, a new one at most 2. 3 x + 2 y is at most 4/9 a, so the 4/9 a + 1 rarest trigrams of
    both texts (repeated ones numbered) share one."""
    ratio = sequential.udfs()["token_sort_ratio"]

    def texts(df: DataFrame) -> DataFrame:
        # the white space of Python's split()
        words = F.filter(F.split("text", r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
        padded = F.concat(F.lit("\x01\x01"), F.array_join(F.array_sort(words), " "), F.lit("\x02\x02"))
        cuts = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
        numbered = F.transform("cuts", lambda g, i: F.concat(g, F.size(F.filter(F.slice("cuts", 1, i), lambda x: x == g)).cast("string")))
        return df.filter("text <> ''").distinct().select("text", (F.length(padded) - 4).alias("n"), cuts.alias("cuts")).filter("n > 0").select("text", "n", numbered.alias("grams"))

    a, b = cut(texts(left)), cut(texts(right))
    seen = b.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("seen"))

    def rarest(df: DataFrame, side: str) -> DataFrame:
        each = df.select("text", "n", "grams", F.explode("grams").alias("gram")).join(seen, "gram", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
        place = F.row_number().over(Window.partitionBy("text").orderBy("seen", "gram"))
        return each.withColumn("_p", place).filter("_p <= 4 * n div 9 + 1").select("gram", *(F.col(c).alias(f"{side}_{c}") for c in ("text", "n", "grams")))

    met = rarest(a, "l").join(rarest(b, "r"), "gram").filter("184 * greatest(l_n, r_n) <= 216 * least(l_n, r_n)")
    # of the trigrams of each, so many are left
    left_over = lambda m, n: F.expr(f"{m} + 2 - 3 * ({m} - (46 * (l_n + r_n) + 99) div 100) - 2 * ({n} - (46 * (l_n + r_n) + 99) div 100)")
    met = met.filter(F.size(F.array_intersect("l_grams", "r_grams")) >= F.greatest(left_over("l_n", "r_n"), left_over("r_n", "l_n")))
    pairs = met.select(F.col("l_text").alias("left"), F.col("r_text").alias("right")).distinct()
    return cut(pairs.withColumn("ratio", ratio("left", "right"))).filter(F.col("ratio") >= FUZZY_FLOOR)


def primary_tokens(name: Column) -> Column:
    """The first salt-free word of each ingredient, distinct, none empty."""
    return F.filter(F.array_distinct(F.transform(names.ingredients(name), lambda i: F.element_at(F.split(names.stripped_name(i), " "), 1))), lambda t: t != "")


def resolve_products(questions: DataFrame, products: DataFrame) -> DataFrame:
    """questions: question_id, question; products: name (distinct). Returns question_id, status, name, by_name, candidates.

    A product is named when all its primary tokens are whole words of the question; products whose tokens are a strict
    subset of another named one's drop out, unless the question compares."""
    words = F.array_distinct(F.filter(F.split(F.lower("question"), r"(?U)[^\w]+"), lambda w: w != ""))
    q = questions.select("question_id", "question", words.alias("words"))
    p = products.select("name").distinct().withColumn("need", primary_tokens(F.col("name"))).filter(F.size("need") > 0)
    full = F.filter(F.array_distinct(F.split(F.lower("name"), "[^a-z]+")), lambda w: F.length(w) >= 3)
    met = q.select("question_id", F.explode("words").alias("token")).join(p.select("name", F.size("need").alias("n"), F.explode("need").alias("token")), "token")
    named = met.groupBy("question_id", "name", "n").agg(F.count("*").alias("hit")).filter("hit = n").select("question_id", "name")
    named = named.join(p.select("name", "need", full.alias("full")), "name").join(q.select("question_id", "words"), "question_id")
    a, b = named.select("question_id", "name", "need"), named.select("question_id", F.col("name").alias("other"), F.col("need").alias("more"))
    dominated = a.join(b, "question_id").filter((F.size(F.array_except("need", "more")) == 0) & (F.size("more") > F.size("need"))).select("question_id", "name").distinct()
    best = named.join(dominated, ["question_id", "name"], "left_anti")
    total = products.select("name").filter("name is not null").distinct().agg(F.count("*").alias("known"), F.min("name").alias("only"))
    all_named = named.groupBy("question_id").agg(F.array_sort(F.collect_set("name")).alias("every"))
    spelled = F.size(F.array_except("full", "words")) == 0
    tops = best.groupBy("question_id").agg(F.array_sort(F.collect_set("name")).alias("top"), F.array_sort(F.collect_set(F.when(spelled, F.col("name")))).alias("exact"))
    out = q.join(all_named, "question_id", "left").join(tops, "question_id", "left").crossJoin(small(total, 1))
    none = F.array().cast("array<string>")
    every, top, exact = (F.coalesce(c, none) for c in ("every", "top", "exact"))
    compares = text.is_comparison(F.col("question")) & (F.size(every) >= 2)
    one = F.when(F.size(top) == 1, F.try_element_at(top, F.lit(1))).when((F.size(top) > 1) & (F.size(exact) == 1), F.try_element_at(exact, F.lit(1)))
    status = F.when(compares, "ambiguous").when(one.isNotNull(), "resolved").when(F.size(top) > 1, "ambiguous").when(F.col("known") == 1, "resolved").otherwise("none")
    name = F.when(compares, None).when(one.isNotNull(), one).when((F.size(top) == 0) & (F.col("known") == 1), F.col("only"))
    return out.select("question_id", status.alias("status"), name.alias("name"), (~compares & one.isNotNull()).alias("by_name"), F.when(compares, every).when(status == "ambiguous", top).otherwise(none).alias("candidates"))


def suggestions(questions: DataFrame, products: DataFrame, floor: float = 82.0, k: int = 3) -> DataFrame:
    """question_id, name, ratio: up to k products whose primary token is nearest to a word of the question."""
    words = F.filter(F.array_distinct(F.split(F.lower("question"), "[^a-z]+")), lambda w: F.length(w) >= 4)
    q = questions.select("question_id", F.explode(words).alias("word"))
    p = products.select("name").distinct().select("name", F.explode(primary_tokens(F.col("name"))).alias("token"))
    scored = spelling.alike(q.select("word"), p.select("token"), floor)
    best = q.join(scored, "word").join(p, "token").groupBy("question_id", "name").agg(F.max("ratio").alias("ratio"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("ratio"), "name"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def named_elsewhere(questions: DataFrame, external: DataFrame, own: DataFrame, most: int = 100) -> DataFrame:
    """question_id, name, covered: external names that contain a word of four letters of the question (up to most in order
    of name), and whether any of their words is one of our products' tokens."""
    words = F.filter(F.array_distinct(F.split(F.lower("question"), "[^a-z]+")), lambda w: F.length(w) >= 4)
    q = questions.select("question_id", F.explode(words).alias("needle"))
    e = external.select(F.col("name").alias("text_id"), F.lower("name").alias("text")).distinct()
    hits = q.join(containment.contained(q, e), "needle").select("question_id", F.col("text_id").alias("name")).distinct()
    hits = hits.withColumn("_r", F.row_number().over(Window.partitionBy("question_id").orderBy("name"))).filter(F.col("_r") <= most).drop("_r")
    ours = own.select(F.explode(primary_tokens(F.col("name"))).alias("token")).distinct()
    in_ours = hits.select("name").distinct().select("name", F.explode(F.split(F.lower("name"), "[^a-z]+")).alias("token")).join(ours, "token", "left_semi").select("name").distinct().withColumn("covered", F.lit(True))
    return hits.join(in_ours, "name", "left").select("question_id", "name", F.coalesce("covered", F.lit(False)).alias("covered"))


def guidance_matches(asked: DataFrame, guidances: DataFrame) -> DataFrame:
    """asked: ask_id, name, number, form; guidances: guidance_id, name, number, references (comma-joined), form.
    A guidance matches by name, by number or by a reference; form_status is match, differs or unverifiable."""
    a = asked.select("ask_id", F.col("form").alias("_want"), names.canonical_name(F.col("name")).alias("_canon"), names.stripped_name(F.col("name")).alias("_strip"), names.bare_application_number(F.col("number")).alias("_no"))
    g = guidances.withColumns({"_gc": names.canonical_name(F.col("name")), "_gs": names.stripped_name(F.col("name"))})
    refs = guidances.select("guidance_id", F.explode(F.transform(F.split("references", ","), lambda t: F.lpad(F.trim(t), 6, "0"))).alias("_no"))
    pairs = [
        a.join(g, F.col("_canon") == F.col("_gc")).filter("_canon <> ''").select("ask_id", "guidance_id"),
        a.join(g, F.col("_strip") == F.col("_gs")).filter("_strip <> ''").select("ask_id", "guidance_id"),
        a.join(g.select("guidance_id", F.col("number").alias("_n2")), F.col("_no") == F.col("_n2")).select("ask_id", "guidance_id"),
        a.join(refs, "_no").select("ask_id", "guidance_id"),
    ]
    every = pairs[0]
    for p in pairs[1:]:
        every = every.union(p)
    hit = every.distinct().join(a.select("ask_id", "_want"), "ask_id").join(guidances, "guidance_id")
    blank = (F.coalesce("_want", F.lit("")) == "") | (F.coalesce("form", F.lit("")) == "")
    return hit.withColumn("form_status", F.when(blank, "unverifiable").when(names.forms_match(F.col("_want"), F.col("form")), "match").otherwise("differs")).drop("_want")


def applications(asked: DataFrame, products: DataFrame) -> DataFrame:
    """asked: ask_id, ingredient, brand; products: appl_no, ingredient, brand. Distinct ask_id, appl_no whose canonical names
    contain the asked ones (an empty one asks nothing; two empty ones match nothing)."""
    canon = lambda df, p: df.select(*[c for c in df.columns if c not in ("ingredient", "brand")], names.canonical_name(F.col("ingredient")).alias(f"{p}i"), names.canonical_name(F.col("brand")).alias(f"{p}b"))
    a, p = canon(asked, "_a"), canon(products, "_p").filter("appl_no is not null and appl_no <> ''")

    def holding(rows: DataFrame, own: str, theirs: str) -> DataFrame:
        texts = p.select(F.col(theirs).alias("text_id"), F.col(theirs).alias("text")).distinct()
        found = containment.contained(rows.select(F.col(own).alias("needle")), texts).select(F.col("needle").alias(own), F.col("text_id").alias(theirs))
        return rows.join(found, own).join(p, theirs)

    by_both = holding(a.filter("_ai <> ''"), "_ai", "_pi").filter((F.col("_ab") == "") | F.contains("_pb", "_ab"))
    by_brand = holding(a.filter("_ai = '' and _ab <> ''"), "_ab", "_pb")
    return by_both.select("ask_id", "appl_no").union(by_brand.select("ask_id", "appl_no")).distinct()


def missed_alerts(pairs: DataFrame, versions: DataFrame, alerts: DataFrame) -> DataFrame:
    """pairs: doc_id, product_id. Those whose document's latest version has no alert for the product."""
    return pairs.join(latest(versions, "doc_id", "captured_at", "version_id"), "doc_id").join(alerts.select("doc_id", "version_id", "product_id"), ["doc_id", "version_id", "product_id"], "left_anti")
