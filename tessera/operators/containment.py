"""Which texts contain which needles: a substring join by the rarest window of each needle.

A needle of WIDTH characters or more is found by one of its windows of WIDTH characters, the one that fewest texts have; a shorter one by
itself. Texts are scanned twice with a bitmap: once to count the texts that have the needles' windows, once to find those with
a chosen one. Pairs that share the chosen window are compared. Needles without any text drop out after the counting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..tables import small
from . import grams

WIDTH = 6


def _plain(text: str | None) -> str:
    return text or ""


@F.pandas_udf(ArrayType(LongType()))
def _windows(needle: pd.Series) -> pd.Series:
    """Hashes of the windows of needles that aren't empty."""
    return needle.map(lambda t: np.unique(grams.signed(grams.window_hashes(grams.codes_of(t), min(WIDTH, len(t))))))


def contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needles: needle; texts: text_id (unique), text. Distinct needle, text_id where the text contains the needle, case included.

    Null needles and texts are in no pair, nor is the empty needle; equal needles are looked up once."""
    asked = needles.select("needle").filter("needle <> ''").distinct()
    windows = asked.select("needle", F.explode(_windows("needle")).alias("gram"))
    widths = sorted(r[0] for r in asked.select(F.least(F.length("needle"), F.lit(WIDTH))).distinct().collect())  # WIDTH at most
    bodies = texts.select("text_id", "text").filter("text is not null")
    counts = grams.counted(bodies.select("text"), grams.bitmap(windows), widths, _plain)
    chosen = windows.join(counts, "gram").groupBy("needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    hits = grams.scanned(bodies, grams.bitmap(chosen), widths, _plain, lambda width: True)
    pairs = hits.select("gram", "text_id").join(small(chosen, asked.count()), "gram").select("needle", "text_id")
    return pairs.join(bodies, "text_id").filter(F.contains("text", "needle")).select("needle", "text_id")
