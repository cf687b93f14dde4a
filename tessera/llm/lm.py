"""Language-model scoring: stupid backoff from n-gram counts of the whole corpus, leaving out the scored document.

Texts are exploded into n-grams of every order, a chunk of documents at a time; each chunk sends its distinct n-grams
with their counts, sorted, to the hash buckets; a bucket is a partition of the count tables: it sums the counts and
returns them to the chunks (through several exchanges where chunks are many), which look every n-gram up, subtract what the document itself contributed, and sum the log
scores per document.

Score of word i: for the longest context of up to order - 1 words with which it occurs in another document, the
relative frequency there, times alpha for each order backed off; for a word of no other document, alpha to the order,
over the number of words of all other documents (1 at least).

Defined results: null and empty texts have 0 words, log score 0 and a null mean; repeated rows are documents of their
own; an empty table gives an empty result; other columns are ignored. n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read
from .packed import CHUNK_BYTES, FAN, by_hash, evened, exchanged, get, get_small, ids_out, pack, put, put_small, split_by_bucket, text_bytes, unpack, widths
from .words import WordHash, grams

ORDER, ALPHA = 2, 0.4
BLOCK, ANSWER = "bucket int, chunk int, keys binary, counts binary", "chunk int, bucket int, counts binary"
_HASHES = WordHash()


def _grams(words: np.ndarray, order: int) -> np.ndarray:
    return words if order == 1 else grams(words, order, 7)


def _exploded(blobs: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Ids, words of each document; and of orders 1 to order, document by document: the n-grams' hashes and the places of
    their first words among all words."""
    ids, bodies = unpack(blobs)
    words = [_HASHES.hashes(t.split()) for t in bodies]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.concatenate(words) if words else np.empty(0, np.uint64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))
    places = [np.flatnonzero(left >= n) for n in range(1, order + 1)]
    return ids, lengths, [_grams(flat, n)[at] for n, at in enumerate(places, 1)], places


def _elsewhere(own: np.ndarray, document: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each n-gram of a chunk (its document, rising), the occurrences in other documents. keys, counts: sorted, of all."""
    order = np.argsort(own, kind="stable")  # documents of an n-gram stay in order
    key, doc = own[order], document[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    start = np.flatnonzero(new | np.concatenate([[True], doc[1:] != doc[:-1]])[: len(key)])
    here = np.diff(np.append(start, len(key)))
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(counts[np.searchsorted(keys, key[start])] - here, here)
    return out.astype(float)


def _blocks(keys: np.ndarray, counts: np.ndarray, words: int, buckets: int, width: int, chunk: int) -> pa.Table:
    """A block per range of width buckets, and the number of words for the range -1."""
    rows = [(b, put(keys[s:e]), put_small(counts[s:e])) for b, s, e in split_by_bucket(keys, buckets, width)]
    if words is not None:
        rows.append((-1, words.to_bytes(8, "little"), b""))
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.table({"bucket": pa.array(cols[0], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "keys": pa.array(cols[1], pa.binary()), "counts": pa.array(cols[2], pa.binary())})


def _summed(got: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the blocks, their distinct n-grams with sums, and of every entry the n-gram's place."""
    keys = [get(r) for r in got["keys"].to_pylist()]
    own = [get_small(c, len(k)) for c, k in zip(got["counts"].to_pylist(), keys)]
    distinct, entry = np.unique(np.concatenate(keys), return_inverse=True)
    return [len(k) for k in keys], distinct, np.bincount(entry, np.concatenate(own).astype(float)).astype(np.uint64), entry


def _words(raw: list[bytes]) -> int:
    return sum(int.from_bytes(r, "little") for r in raw)


def _answers(got: pa.Table, parts: list[bytes]) -> pa.Table:
    """parts: what goes back for each block of got."""
    return pa.table({"chunk": got["chunk"], "bucket": got["bucket"], "counts": pa.array(parts, pa.binary())})


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    """docs: doc_id, text -> doc_id, n_words, log_score (sum of natural logarithms), mean_log_score.

    fan: blocks that a chunk sends and a bucket gets in one exchange."""
    _, total = text_bytes(docs)
    chunk_of, chunks = by_hash(total, chunk_bytes)
    buckets = max(16, chunks)
    fan = evened(chunks, buckets, fan)
    steps = widths(chunks, buckets, fan)
    packed = pack(docs, chunk_of)

    def count(key: tuple, blobs: pa.Table) -> pa.Table:
        _, lengths, all_grams, _ = _exploded(blobs, order)
        keys, counts = np.unique(np.concatenate(all_grams), return_counts=True)
        return _blocks(keys, counts, int(lengths.sum()), buckets, steps[0], key[0].as_py())

    def forward(width: int):
        def run(key: tuple, got: pa.Table) -> pa.Table:
            if key[0].as_py() < 0:
                return _blocks(np.empty(0, np.uint64), np.empty(0, np.uint64), _words(got["keys"].to_pylist()), buckets, width, key[1].as_py())
            _, keys, sums, _ = _summed(got)
            return _blocks(keys, sums, None, buckets, width, key[1].as_py())

        return run

    def add(key: tuple, got: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return _answers(got, [_words(got["keys"].to_pylist()).to_bytes(8, "little")] * len(got))
        lengths, _, sums, entry = _summed(got)
        return _answers(got, [put_small(x) for x in np.split(sums[entry], np.cumsum(lengths)[:-1])])

    def back(width: int):
        def run(key: tuple, got: pa.Table, above: pa.Table) -> pa.Table:
            answers = dict(zip(above["bucket"].to_pylist(), above["counts"].to_pylist()))
            if -1 in answers:
                return _answers(got, [answers[-1]] * len(got))
            lengths, keys, _, entry = _summed(got)
            sums = np.concatenate([get_small(answers[b], e - s) for b, s, e in split_by_bucket(keys, buckets, width)])
            return _answers(got, [put_small(x) for x in np.split(sums[entry], np.cumsum(lengths)[:-1])])

        return run

    def sum_up(key: tuple, blobs: pa.Table, answers: pa.Table) -> pa.Table:
        ids, lengths, all_grams, places = _exploded(blobs, order)
        keys = np.unique(np.concatenate(all_grams))
        got = dict(zip(answers["bucket"].to_pylist(), answers["counts"].to_pylist()))
        all_words = int.from_bytes(got[-1], "little") if got else 0
        parts = [get_small(got[b], e - s) for b, s, e in split_by_bucket(keys, buckets, steps[0])]
        counts = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
        document = np.repeat(np.arange(len(lengths)), lengths)
        others = np.maximum(all_words - lengths, 1)[document]
        first = np.cumsum(lengths) - lengths
        shorter = one = _elsewhere(all_grams[0], document, keys, counts)
        logp = np.log(np.where(one > 0, one / others * alpha ** (order - 1), alpha**order / others))
        for k in range(2, order + 1):  # the k-gram that ends at word i starts at i - k + 1, as does its context
            num = _elsewhere(all_grams[k - 1], document[places[k - 1]], keys, counts)
            den = shorter[np.searchsorted(places[k - 2], places[k - 1])]
            found = num > 0
            logp[places[k - 1][found] + k - 1] = np.log(num[found] / den[found] * alpha ** (order - k))
            shorter = num
        # the first words of a text have shorter contexts: no penalty for orders that they can't have
        short = np.minimum(np.arange(len(document)) - first[document], order - 1)
        logp -= np.log(alpha) * (order - 1 - short)
        n_words = lengths.tolist()
        logs = [float(logp[s : s + n].sum()) for s, n in zip(first.tolist(), n_words)]
        mean = [x / n if n else None for x, n in zip(logs, n_words)]
        return pa.table({"doc_id": ids_out(ids), "n_words": pa.array(n_words, pa.int64()), "log_score": pa.array(logs, pa.float64()), "mean_log_score": pa.array(mean, pa.float64())})

    counted = packed.groupBy("chunk").applyInArrow(count, BLOCK)
    summed = exchanged(counted, steps, fan, forward, lambda sent: sent.groupBy("bucket").applyInArrow(add, ANSWER), back, BLOCK, ANSWER)
    return packed.groupBy("chunk").cogroup(summed.groupBy("chunk")).applyInArrow(sum_up, "doc_id long, n_words long, log_score double, mean_log_score double")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return score(read(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("mean_log_score", 6).alias("mean_log_score"))


OP7_SQL = """
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS b, unnest(list_concat([NULL], ws)[1:len(ws)]) AS a FROM w),
n AS (SELECT count(*) AS n FROM p),
len AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
u AS (SELECT b, count(*) AS c FROM p GROUP BY b),
ud AS (SELECT doc_id, b, count(*) AS c FROM p GROUP BY doc_id, b),
g AS (SELECT a, b, count(*) AS c FROM p WHERE a IS NOT NULL GROUP BY a, b),
gd AS (SELECT doc_id, a, b, count(*) AS c FROM p WHERE a IS NOT NULL GROUP BY doc_id, a, b),
s AS (
  SELECT p.doc_id, i, greatest(n.n - len.n, 1) AS others, u.c - ud.c AS cb, coalesce(g.c - gd.c, 0) AS cab, ua.c - uda.c AS ca
  FROM p CROSS JOIN n JOIN len USING (doc_id) JOIN u USING (b) JOIN ud USING (doc_id, b)
  LEFT JOIN g ON g.a = p.a AND g.b = p.b LEFT JOIN gd ON gd.doc_id = p.doc_id AND gd.a = p.a AND gd.b = p.b
  LEFT JOIN u ua ON ua.b = p.a LEFT JOIN ud uda ON uda.doc_id = p.doc_id AND uda.b = p.a),
l AS (SELECT doc_id, ln(CASE WHEN cab > 0 THEN cab / ca
                             ELSE (CASE WHEN i = 1 THEN 1 ELSE 0.4 END) * (CASE WHEN cb > 0 THEN cb / others ELSE 0.4 / others END) END) AS x FROM s)
SELECT w.doc_id, len(any_value(ws))::BIGINT AS n_words, round(sum(x) / count(x), 6) AS mean_log_score
FROM w LEFT JOIN l USING (doc_id) GROUP BY w.doc_id
"""
