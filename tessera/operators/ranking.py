"""Exact top-k, diversity, paging and picks; every order is total."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.numbers import cosine_distance, score
from ..functions.sequential import mmr
from ..tables import small
from . import cells


def top_k(rows: DataFrame, query: list[float], k: int, where: Column | None = None, id_: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest by cosine, ties by id, with distance and score; k under 1 gives none, as does an empty query. The filter goes first (Catalyst
    pushes it into the scan), null vectors and those of another length have no distance and are left out."""
    if k <= 0 or not query:
        return rows.limit(0).withColumns({"distance": F.lit(0.0), "score": F.lit(0.0)})
    if where is not None:
        rows = rows.filter(where)
    asked = F.array(*(F.lit(float(x)) for x in query))
    near = rows.withColumn("distance", cosine_distance(F.col(vector), asked)).filter("distance is not null")
    return near.orderBy("distance", id_).limit(k).withColumn("score", score(F.col("distance")))


#: Queries that a scanning task holds; more of them meet the rows in blocks of this size, rows in packs of PACK, or fewer if that many components are more than PACKED.
BLOCK, PACK, PACKED = 4_096, 65_536, 1 << 21


def _queries_by_length(asked: pa.Table) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """length -> (query_ids, unit vectors) of usable query vectors."""
    column = asked["query"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    ids, out = asked["query_id"].combine_chunks(), {}
    for dim in {int(n) for n in column.value_lengths().drop_null().to_pylist() if n}:
        at, v = cells.units(column, dim)
        if len(at):
            out[dim] = ids.take(pa.array(at)), v
    return out


def _nearest(asked: dict[int, tuple[pa.Array, np.ndarray]], rows: pa.RecordBatch | pa.Table, k: int, id_: str) -> Iterator[pa.RecordBatch]:
    """query_id, id, about: candidates for the k nearest of each query among rows (id, vector), with their distances but for rounding."""
    ids, column = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (rows[id_], rows["vector"]))
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    for dim, (queries, q) in asked.items():
        at, v = cells.units(column, dim)
        if not len(at):
            continue
        ours = ids.take(pa.array(at))
        asked_at, rows_at, about = cells.candidates(q, v, ours, k)
        yield pa.RecordBatch.from_arrays([queries.take(pa.array(asked_at)), ours.take(pa.array(rows_at)), pa.array(about)], names=["query_id", id_, "about"])


def top_k_each(rows: DataFrame, queries: DataFrame, k: int, id_: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """queries: query_id (distinct), query (vector). The k nearest rows of each query, ties by id. Candidates come from matrix products of a batch of
    rows with a block of queries, as ids; those that no nearer k of the query's rule out get their vectors, and distances as top_k() computes them.
    Up to BLOCK queries rows are scanned where they are; more meet them in blocks and packs. Null, zero and unusable vectors are near nothing, lengths
    must be equal."""
    n = queries.count()
    queries = queries.select("query_id", "query")
    rows = rows.select(id_, F.col(vector).alias("vector"))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {id_} {rows.schema[id_].dataType.simpleString()}, about double"
    if n <= BLOCK:
        held = _queries_by_length(queries.toArrow()) if n and k > 0 else {}

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _nearest(held, batch, k, id_)

        near = rows.mapInArrow(scan, kinds)
    else:
        total, longest = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
        blocks, packs = -(-n // BLOCK), -(-total // min(PACK, max(1, PACKED // max(1, longest or 1)))) or 1
        deal = lambda df, c, own, m, other, o: df.withColumns({own: F.pmod(F.xxhash64(c), F.lit(m)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(o - 1)))})
        left, right = deal(rows, id_, "pack", packs, "block", blocks), deal(queries, "query_id", "block", blocks, "pack", packs)

        def meet(key: tuple, some: pa.Table, asked: pa.Table) -> pa.Table:
            schema = pa.schema([("query_id", asked.schema.field("query_id").type), (id_, some.schema.field(id_).type), ("about", pa.float64())])
            return pa.Table.from_batches([b.cast(schema) for b in _nearest(_queries_by_length(asked), some, k, id_)] if k > 0 else [], schema)

        near = left.groupBy("pack", "block").cogroup(right.groupBy("pack", "block")).applyInArrow(meet, kinds)
    own = Window.partitionBy("query_id")
    near = near.withColumn("_n", F.row_number().over(own.orderBy("about"))).withColumn("_kth", F.max(F.when(F.col("_n") <= k, F.col("about"))).over(own))
    near = near.filter(F.col("about") <= F.col("_kth") + cells.NOISE).select("query_id", F.col(id_).alias("_id")).distinct()
    met = near.join(rows, F.col("_id").eqNullSafe(F.col(id_))).join(small(queries, n), "query_id").withColumn("distance", cosine_distance(F.col("vector"), F.col("query"))).filter("distance is not null")
    rank = F.row_number().over(own.orderBy("distance", id_))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", id_, "rank", "distance", score(F.col("distance")).alias("score"))


def approximate(rows: DataFrame, queries: DataFrame, k: int, id_: str = "chunk_id", vector: str = "embedding", recall: float = 0.95, probes: int | None = None) -> DataFrame:
    """The k nearest of each query by an inverted file, candidates ranked exactly. Off unless asked for."""
    found = cells.index(rows, id_=id_, vector=vector)
    if found is None:
        return top_k_each(rows.limit(0), queries, k, id_, vector)
    return cells.nearest(found, queries, k, probes, recall)


def diverse(passages: DataFrame, k: int, weight: float = 0.7, query: str = "query_id", order: str = "position") -> DataFrame:
    """passages: query, order, score, text. The passages picked by maximal marginal relevance, with pick from 1. Greedy, so a
    query's pool (bounded by its top-k) is one group."""

    def run(key: tuple, pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(order).reset_index(drop=True)
        at = mmr([None if pd.isna(s) else float(s) for s in pool["score"]], pool["text"].tolist(), k, weight)
        return pool.iloc[at].assign(pick=range(1, len(at) + 1))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passages.schema) + ", pick int"
    return passages.groupBy(query).applyInPandas(run, kinds)


def trimmed(passages: DataFrame, k: int, floor: float, diversify: bool, query: str = "query_id", order: str = "position") -> DataFrame:
    """Passages above the floor, diversified, or just the first k."""
    if diversify:
        return diverse(passages.filter(F.col("score") >= floor), k, query=query, order=order)
    pick = F.row_number().over(Window.partitionBy(query).orderBy(order))
    return passages.withColumn("pick", pick).filter(F.col("pick") <= k)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def counted_page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of a total order, each row with total, the number of all rows; a page behind the last row has none."""
    total = rows.agg(F.count("*").alias("total"))
    return page(rows, order, limit, offset).crossJoin(small(total, 1)).orderBy(*order)


def keyset_page(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    return (rows if after is None else rows.filter(F.col(key) > after)).orderBy(key).limit(limit)


def preferred_listing(listings: DataFrame, group: str, titles: list[str], labelers: list[str]) -> DataFrame:
    """listings: group, position, title, published. Of each group the newest of those whose title matches, else whose labeler
    does, else of all; the smaller position wins ties; unreadable dates are oldest."""
    any_of = lambda c, wants: F.exists(F.array(*map(F.lit, wants)), lambda w: names.contains_either_way(c, w)) if wants else F.lit(False)
    tier = F.when(any_of(F.col("title"), titles), 2).when(F.coalesce(any_of(names.labeler(F.col("title")), labelers), F.lit(False)), 1).otherwise(0)
    stamp = F.coalesce(F.to_date(F.try_to_timestamp("published", F.lit("MMM d, yyyy"))), F.lit("0001-01-01").cast("date"))
    rest = [c for c in listings.columns if c != group]
    top = F.max_by(F.struct(*rest), F.struct(tier, stamp, -F.col("position")))
    return listings.groupBy(group).agg(top.alias("_t")).select(group, *(F.col(f"_t.{c}").alias(c) for c in rest))


def best_occurrence(sections: DataFrame, *keys: str) -> DataFrame:
    """The longest text of each key, of equals that on the latest page."""
    rest = [c for c in sections.columns if c not in keys]
    return sections.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.length("text"), "page")).alias("_t")).select(*keys, *(F.col(f"_t.{c}").alias(c) for c in rest))


#: Orders of tiers and severities, best first.
TIERS, SEVERITIES = ("verified", "corroborated", "advisory"), ("high", "medium", "low")


def sorted_findings(findings: DataFrame) -> DataFrame:
    """By tier, severity, falling confidence; position keeps equals in order."""
    place = lambda c, names_: F.array_position(F.array(*map(F.lit, names_)), F.col(c))
    return findings.orderBy(place("tier", TIERS), place("severity", SEVERITIES), F.desc("confidence"), "position")


def by_matched_terms(rows: DataFrame, terms: list[str], limit: int, title: str = "title") -> DataFrame:
    """The first limit rows by matched terms (most first), then title; only then are rows without any match dropped."""
    matched = F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(title), F.lower(t))))
    return rows.withColumn("matched", matched).orderBy(F.desc("matched"), title).limit(limit).filter("matched > 0")


def pinned_form(questions: DataFrame, combos: DataFrame, filler: tuple[str, ...] = ("for", "the", "and", "with", "what", "is", "are")) -> DataFrame:
    """questions: question_id, question; combos: question_id, dosage_form, route. The one combination that a question names, else
    no row: most matched words, then fewest of its own left over; a full tie pins nothing, nor does a win by leftovers alone
    when no word of a dosage form was named."""
    q_words = F.filter(F.array_distinct(F.split(F.lower("question"), "[^a-z0-9]+")), lambda t: (t != "") & ~t.isin(*filler))
    long = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+")), lambda t: F.length(t) > 2)
    j = combos.join(questions.select("question_id", q_words.alias("_q")), "question_id").withColumns({"_f": long("dosage_form"), "_c": F.array_union(long("dosage_form"), long("route"))})
    j = j.withColumns({"_m": F.size(F.array_intersect("_c", "_q")), "_fm": F.size(F.array_intersect("_f", "_q"))}).withColumn("_u", F.size("_c") - F.col("_m"))
    w = Window.partitionBy("question_id").orderBy(F.desc("_m"), "_u", "dosage_form", "route")
    j = j.withColumns({"_n": F.row_number().over(w), "_m2": F.lead("_m").over(w), "_u2": F.lead("_u").over(w)}).filter("_n = 1 and _m > 0")
    tie = F.col("_m2").isNotNull() & (F.col("_m2") == F.col("_m"))
    return j.filter(~F.coalesce(tie & (F.col("_u2") == F.col("_u")), F.lit(False)) & ~F.coalesce(tie & (F.col("_fm") == 0), F.lit(False))).select("question_id", "dosage_form", "route")


def related_names(passages: DataFrame, query: str = "query_id", order: str = "position") -> DataFrame:
    """Distinct product names of a query in retrieval order."""
    first = passages.filter("trim(normalized_name) <> ''").groupBy(query, F.trim("normalized_name").alias("name")).agg(F.min(order).alias("position"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("position")))
