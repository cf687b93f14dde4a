"""Quotes against all pages: an approximate substring join through a seed index.

A quote that may have k edits is cut into k + 1 pieces; one of them stands unchanged on every page that holds the quote. The
first characters of each piece (as many as the largest of SEEDS that fits) are its seed. Pages are scanned once: a window's
hash is looked up in a bitmap of all seeds' hashes, whose size doesn't depend on the number of quotes, and the few windows that
pass are joined with the seeds by hash. A joint seed places the quote on the page; only the text around these places is
aligned. The outcome is that of sequential.quote_match on every pair; quotes too short for edits are looked up as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequential import LEAST_FUZZY, budget_of, match_form, placed
from ..tables import small
from . import grams

#: Lengths of seeds; shorter pieces belong to quotes that are looked up whole.
SEEDS = (6, 10, 16, 24)
#: Quotes whose places on one page are checked in one group.
GROUP = 2000

def _hash(text: str) -> int:
    return int(grams.signed(grams.window_hashes(grams.codes_of(text), len(text)))[0])


def seeds_of(norm: str) -> list[tuple[int, int, int]]:
    """(width, place in the quote, hash) of the seeds of a normal form."""
    n = len(norm)
    if n < LEAST_FUZZY:
        return [(n, 0, _hash(norm))] if n else []
    pieces = budget_of(norm) + 1
    edges, out = [n * k // pieces for k in range(pieces + 1)], []
    for a, b in zip(edges, edges[1:]):
        width = max(w for w in SEEDS if w <= b - a)
        out.append((width, a, _hash(norm[a : a + width])))
    return out


def seed_table(quotes: DataFrame) -> DataFrame:
    """quotes: quote_id, quote -> distinct normal forms with their seeds: norm, width, place, gram."""

    @F.pandas_udf("struct<norm:string,seeds:array<struct<width:int,place:int,gram:long>>>")
    def seeded(quote: pd.Series) -> pd.DataFrame:
        norms = quote.map(match_form)
        return pd.DataFrame({"norm": norms, "seeds": norms.map(lambda q: [dict(zip(("width", "place", "gram"), s)) for s in seeds_of(q)])})

    s = quotes.select("quote").distinct().select(seeded("quote").alias("s"))
    return s.select("s.norm", "s.seeds").distinct().select("norm", F.inline("seeds"))


def quote_pairs(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """quotes: quote_id, quote; pages: page_id (unique), text. The pairs found: quote_id, page_id, exact, distance.

    Null and empty quotes and pages are found nowhere; equal quotes are searched once."""
    norms = F.pandas_udf(lambda q: q.map(match_form), "string")
    seeds = seed_table(quotes)
    widths = [r["width"] for r in seeds.select("width").distinct().collect()]  # 15 at most
    n = seeds.select("norm").distinct().count()
    # a quote that is looked up whole needs no places
    hits = grams.scanned(pages.select("page_id", "text"), grams.bitmap(seeds), sorted(widths), match_form, lambda width: width < LEAST_FUZZY and width not in SEEDS)
    places = hits.join(small(seeds, 4 * n), "gram")
    part = F.pmod(F.xxhash64("norm"), F.lit(-(-n // GROUP) or 1))
    groups = places.groupBy("page_id", part.alias("part")).agg(F.collect_list(F.struct("norm", "place", "at")).alias("places"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, text, places in zip(*(batch.column(i).to_pylist() for i in range(3))):
                hay, by = match_form(text), {}
                for p in places:
                    by.setdefault(p["norm"], []).extend(a - p["place"] for a in p["at"])
                for norm, starts in by.items():
                    found, exact, distance = placed(norm, hay, starts)
                    if found:
                        out.append((page, norm, exact, distance))
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int32())], names=["page_id", "norm", "exact", "distance"])

    found = groups.join(pages.select("page_id", "text"), "page_id").select("page_id", "text", "places").mapInArrow(check, f"page_id {kind}, norm string, exact boolean, distance int")
    return quotes.select("quote_id", norms("quote").alias("norm")).join(found, "norm").select("quote_id", "page_id", "exact", "distance")
