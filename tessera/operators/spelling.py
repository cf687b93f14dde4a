"""Words that are spelled alike: pairs at or above an Indel ratio, without meeting all pairs.

Two words with the ratio share a common subsequence of at least half the ratio's share of their letters. Short words meet by it: both
sides are expanded to their long enough subsequences (deletion neighbourhoods) and joined. Where a word is longer, the
number of its subsequences explodes; there one word is cut into one piece more than it may have edits, so that a piece stands
in the other word unchanged, near its place: the words meet by the first two letters of the pieces. Candidates are then compared."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequential
from ..tables import small

#: The longest words that are expanded: at most 299 subsequences at a ratio of 82.
SHORT = 12


def subsequences(word: Column, least: Column, deletions: int) -> Column:
    """The distinct subsequences of word with least letters or more, of which at most deletions are missing."""
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    level = every = F.array(word)
    for _ in range(deletions):
        longer = F.filter(level, lambda w: F.length(w) > F.greatest(least, F.lit(1)))
        level = F.array_distinct(F.flatten(F.transform(longer, without)))
        every = F.concat(every, level)
    return every


def alike(words: DataFrame, tokens: DataFrame, ratio: float = 82.0) -> DataFrame:
    """words: word; tokens: token. Distinct word, token, ratio at or above ratio (above 75). Null and empty ones are like nothing."""
    if not 75 < ratio <= 100:
        raise ValueError("pieces of two letters need a ratio above 75")
    share = ratio / 100
    words = words.select("word").filter("word <> ''").distinct()
    tokens = tokens.select("token").filter("token <> ''").distinct()
    short = lambda c: F.length(c) <= SHORT
    # a common subsequence of m letters: 2 m >= share (a + b) and m <= b, so m >= share a / (2 - share)
    least = lambda c: F.ceil(F.length(c) * (share / (2 - share)) - 1e-9).cast("int")
    most = SHORT - ceil(SHORT * share / (2 - share) - 1e-9)
    keys = lambda df, c: df.filter(short(c)).select(c, F.explode(subsequences(F.col(c), least(F.col(c)), most)).alias("key"))
    m = F.length("key") * 2 >= share * (F.length("word") + F.length("token")) - 1e-9
    by_key = keys(words, "word").join(keys(tokens, "token"), "key").filter(m).select("word", "token")
    # longer words: at most (1 - share) of both words' letters are edits
    longest = lambda c: F.floor(F.length(c) * ((2 - share) / share) + 1e-9)
    allowed = F.floor((F.length("token") + longest("token")) * (1 - share) + 1e-9).cast("int")
    piece = lambda k: F.floor(F.length("token") * k / (F.col("edits") + 1)).cast("int")
    cut = tokens.withColumn("edits", allowed).select("token", "edits", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("k")).select("token", "edits", piece(F.col("k")).alias("at"))
    cut = cut.select("token", "edits", "at", F.substring("token", F.col("at") + 1, F.lit(2)).alias("key"))
    pairs = F.transform(F.sequence(F.lit(0), F.length("word") - 2), lambda i: F.struct(i.alias("place"), F.substring("word", i + 1, F.lit(2)).alias("key")))
    starts = words.filter(F.length("word") >= 2).select("word", F.inline(pairs))
    near = (F.abs(F.col("place") - F.col("at")) <= F.col("edits")) & (~short("word") | ~short("token")) & (F.abs(F.length("word") - F.length("token")) <= (F.length("word") + F.length("token")) * (1 - share) + 1e-9)
    by_piece = starts.join(cut, "key").filter(near).select("word", "token")
    measured = by_key.union(by_piece).distinct().withColumn("ratio", sequential.udfs()["indel_ratio"]("word", "token"))
    return measured.filter(F.col("ratio") >= ratio - 1e-9)
