"""Substring dedup with a log-structured index of window fingerprints.

The index holds sorted immutable runs: per bucket of the fingerprint's range, the sorted fingerprints (64 bits) and
check bytes of all windows of one or more earlier batches. A batch of documents is dealt to chunks in order of doc_id;
each chunk is a run of its own: its windows' distinct fingerprints, sorted, in one block per bucket. A bucket
merge-joins the historical runs and the chunks' runs in order; an entry found in an earlier run is a repeat if its
check, computed from the same words by independent multipliers, agrees too. The answers (a bit per entry) return to
the chunks, which mark covered words. What the merged bucket has beyond the earlier runs is the batch's new run; when
FANOUT runs have gathered, the merged bucket is written as their compaction. Its inputs stay until the next compaction,
so that batches since the one before can be repeated. Two different windows agree in fingerprint and check with a
probability near 2^-72: of 10^13 windows some 10^4 pairs do.

Where chunks are more than FAN, their blocks reach the buckets through several exchanges: as many neighbouring chunks as
there are ranges (FAN at most) are merged by range of buckets, and what is new in the range goes on, so blocks stay large.

Defined results: words are [^\\x20\\x09-\\x0D]+; null texts have none; texts shorter than a window lose nothing; rows of
one doc_id don't make each other's words repeats; null ids come last and never own a window against each other; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, read
from .packed import CHUNK_BYTES, FAN, evened, exchanged, get, ids_out, in_order, pack, put, split_by_bucket, unpack, widths
from .words import WordHash, grams

WINDOW, CHECK_BYTES, FANOUT = 13, 1, 4
#: Chunk numbers of a bucket's runs, and the columns of blocks.
NEW_RUN, COMPACTED = -1, -2
BLOCK = "bucket int, chunk int, keys binary, checks binary"


class _Windows:
    """The windows of a chunk's documents."""

    def __init__(self, blobs: pa.Table, window: int, hashes: WordHash):
        self.ids, self.bodies = unpack(blobs)
        x = [hashes.hashes(t.split()) for t in self.bodies]  # words are split again where they are needed: lists of them are large
        self.first = np.concatenate([[0], np.cumsum([len(h) for h in x])]).astype(np.int64)
        keys = [grams(h, window) for h in x]
        checks = [grams(h, window, 1).astype(np.uint32) & np.uint32((1 << 8 * CHECK_BYTES) - 1) for h in x]
        self.key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        self.check = np.concatenate(checks).astype(np.uint8) if checks else np.empty(0, np.uint8)
        n = np.array([len(k) for k in keys], np.int64)
        del x, keys, checks
        self.doc = np.repeat(np.arange(len(n)), n)
        self.start = np.arange(len(self.key)) - np.repeat(np.cumsum(n) - n, n) + self.first[self.doc]
        order = np.argsort(self.key, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = self.key[order][1:] != self.key[order][:-1]
        self.owner = order[new]  # per distinct key the first window, which is of the smallest id
        self.entry = np.empty(len(order), np.int32)
        self.entry[order] = np.cumsum(new) - 1
        self.keys, self.checks = self.key[self.owner], self.check[self.owner]

    def repeats(self, earlier: np.ndarray) -> np.ndarray:
        """Which windows start in an earlier chunk or run (earlier: per distinct key), or here under a smaller id."""
        same = self.check == self.checks[self.entry]
        return same & (earlier[self.entry] | (self.ids[self.doc] > self.ids[self.doc[self.owner]][self.entry]))


def _sent(keys: np.ndarray, checks: np.ndarray, buckets: int, width: int, chunk: int) -> pa.Table:
    """A block per range of width buckets."""
    rows = [(b, chunk, put(keys[s:e]), checks[s:e].tobytes()) for b, s, e in split_by_bucket(keys, buckets, width)]
    return _table(rows)


def _table(rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 4
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("bucket", "chunk", "keys", "checks"), cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))})


class _Merged:
    """Blocks in order of their chunks, historical runs (chunks below 0) first, merged by fingerprint."""

    def __init__(self, got: pa.Table):
        blocks = sorted(zip(got["bucket"].to_pylist(), got["chunk"].to_pylist(), got["keys"].to_pylist(), got["checks"].to_pylist()), key=lambda b: b[1])
        self.bucket, self.chunks = [b[0] for b in blocks], [b[1] for b in blocks]
        keys = [get(b[2]) for b in blocks]
        self.lengths = [len(k) for k in keys]
        key, check = np.concatenate(keys), np.concatenate([np.frombuffer(b[3], np.uint8) for b in blocks])
        self.order = order = np.argsort(key, kind="stable")
        self.k, self.c = k, c = key[order], check[order]
        self.new = new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        group = np.cumsum(new) - 1
        agrees = c == c[new][group]
        self.by, self.by_first = np.empty(0, np.int64), np.empty(0, bool)
        if not agrees.all():  # equal fingerprints of different windows: the first of each (key, check) owns
            odd = np.flatnonzero(np.isin(group, group[~agrees]))
            self.by = by = odd[np.lexsort((odd, c[odd], k[odd]))]
            new[by] = self.by_first = np.concatenate([[True], (k[by][1:] != k[by][:-1]) | (c[by][1:] != c[by][:-1])])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        return self.k[self.new], self.c[self.new]

    def place(self) -> np.ndarray:
        """Of every entry in order of keys the place of its window in distinct()."""
        at = np.cumsum(self.new) - 1
        if len(self.by):
            at[self.by] = at[self.by[self.by_first]][np.cumsum(self.by_first) - 1]
        return at

    def answers(self, earlier: np.ndarray | None = None) -> list[tuple[int, int, bytes, bytes]]:
        """Rows of bits: which entries of a chunk's block an earlier block has, or are earlier (by entry in order of keys)."""
        seen = np.empty(len(self.k), bool)
        seen[self.order] = ~self.new if earlier is None else ~self.new | earlier
        parts = np.split(seen, np.cumsum(self.lengths)[:-1])
        return [(b, n, np.packbits(x).tobytes(), b"") for b, n, x in zip(self.bucket, self.chunks, parts) if n >= 0]

    def runs(self, add: bool, compact: bool) -> list[tuple[int, int, bytes, bytes]]:
        """The runs asked for: NEW_RUN (what no earlier run has) and COMPACTED (all)."""
        old = sum(n for n, chunk in zip(self.lengths, self.chunks) if chunk < 0)
        asked = ((add, NEW_RUN, self.new & (self.order >= old)), (compact, COMPACTED, self.new))
        return [(self.bucket[0], run, put(self.k[which]), self.c[which].tobytes()) for wanted, run, which in asked if wanted]


def _bits(answers: pa.Table, keys: np.ndarray, buckets: int, width: int) -> np.ndarray:
    """The answers to the blocks of sorted keys, in their order."""
    bits = dict(zip(answers["bucket"].to_pylist(), answers["keys"].to_pylist()))
    parts = [np.unpackbits(np.frombuffer(bits[b], np.uint8), count=e - s) for b, s, e in split_by_bucket(keys, buckets, width)]
    return np.concatenate(parts).astype(bool) if parts else np.empty(0, bool)


def dedup(docs: DataFrame, window: int = WINDOW, index: str | None = None, batch: int = 0, chunk_bytes: int = CHUNK_BYTES, add: bool = True, fanout: int = FANOUT, expected: int = 0, fan: int = FAN) -> DataFrame:
    """docs: doc_id, text -> doc_id, n_words, n_removed, kept (the words left, joined by a space).

    index: a shared folder of runs of earlier batches, all of whose windows count as earlier; batch: the number of this
    batch, whose run is added (unless add is false: the last batch of all). Batches come in order of their numbers. The last
    can be written again, which replaces it; one before it only unchanged, which leaves the index as it is. One that is too
    late, or whose history is already compacted with it, is an error; fanout: runs that are compacted; expected: bytes of text that a new index is laid out for (those of its first
    batch if more); fan: blocks that a chunk sends and a bucket gets of chunks in one exchange. Without index, only the batch itself is compared."""
    spark = docs.sparkSession
    add = add and index is not None
    if index is not None:
        _check_turn(spark, index, batch)
    compact = add and len(_history(spark, index, batch)) + 1 >= fanout
    chunk_of, chunks, total = in_order(docs, chunk_bytes)
    buckets = _buckets(spark, index, max(total, expected), chunk_bytes)
    fan = evened(chunks, buckets, fan)
    steps = widths(chunks, buckets, fan)
    packed = pack(docs, chunk_of)

    def spread(key: tuple, blobs: pa.Table) -> pa.Table:
        w = _Windows(blobs, window, _HASHES)
        return _sent(w.keys, w.checks, buckets, steps[0], key[0].as_py())

    def forward(width: int):
        return lambda key, got: _sent(*_Merged(got).distinct(), buckets, width, key[1].as_py())

    def join(key: tuple, got: pa.Table) -> pa.Table:
        m = _Merged(got)
        return _table(m.answers() + m.runs(add, compact))

    def back(width: int):
        def run(key: tuple, got: pa.Table, above: pa.Table) -> pa.Table:
            m = _Merged(got)
            return _table(m.answers(_bits(above, m.distinct()[0], buckets, width)[m.place()]))

        return run

    def mark(key: tuple, blobs: pa.Table, answers: pa.Table) -> pa.Table:
        w = _Windows(blobs, window, _HASHES)
        hit = w.start[w.repeats(_bits(answers, w.keys, buckets, steps[0]))]
        change = np.zeros(int(w.first[-1]) + 1, np.int32)
        change[hit] += 1
        change[hit + window] -= 1
        stays = np.cumsum(change[:-1]) == 0
        kept, removed = [], []
        for i, words in enumerate(t.split() for t in w.bodies):
            s = stays[w.first[i] : w.first[i + 1]]
            gone = len(s) - int(s.sum())
            kept.append(b" ".join(compress(words, s.tolist()) if gone else words))
            removed.append(gone)
        return pa.table({"doc_id": ids_out(w.ids), "n_words": pa.array(np.diff(w.first), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    def joined(blocks: DataFrame) -> DataFrame:
        if index is not None:
            blocks = blocks.unionByName(_runs(spark, index, batch))
        merged = blocks.groupBy("bucket").applyInArrow(join, BLOCK)
        if add:
            made = f"{index}/batches/{batch:08d}-{uuid.uuid4()}"
            kinds = F.when(F.col("chunk") == NEW_RUN, "new").when(F.col("chunk") == COMPACTED, "compacted").otherwise("answers")
            merged.withColumn("kind", kinds).write.partitionBy("kind").parquet(made)
            _settle(spark, index, batch, made, buckets, compact)
            merged = _blocks(spark, f"{made}/kind=answers")  # the result reads it later
        return merged

    answers = exchanged(packed.groupBy("chunk").applyInArrow(spread, BLOCK), steps, fan, forward, joined, back, BLOCK, BLOCK)
    return packed.groupBy("chunk").cogroup(answers.select("chunk", "bucket", "keys").groupBy("chunk")).applyInArrow(mark, "doc_id long, n_words long, n_removed long, kept string")


_HASHES = WordHash()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, index: str) -> list[str]:
    fs, p = _fs(spark, f"{index}/runs")
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _buckets(spark: SparkSession, index: str | None, total: int, chunk_bytes: int) -> int:
    """An index keeps the number of buckets it began with (in its runs' names)."""
    have = _names(spark, index) if index else []
    return int(have[0].split("-")[-1]) if have else max(16, -(-total // chunk_bytes))


def _span(name: str) -> tuple[int, int]:
    return tuple(int(x) for x in name.split("-")[:2])


def _check_turn(spark: SparkSession, index: str, batch: int) -> None:
    spans = [_span(n) for n in _names(spark, index)]
    if any(to > batch for _, to in spans) and (batch, batch) not in spans:
        raise ValueError(f"batch {batch} comes after later ones, and its history is not kept apart from them")


def _history(spark: SparkSession, index: str, batch: int) -> list[str]:
    """The runs of batches before this one, without those that a compaction among them holds."""
    older = [n for n in _names(spark, index) if _span(n)[1] < batch]
    within = lambda a, b: a != b and b[0] <= a[0] and a[1] <= b[1]
    return [n for n in older if not any(within(_span(n), _span(m)) for m in older)]


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks under a path; none if a batch had no windows and so wrote none."""
    fs, p = _fs(spark, path)
    return spark.read.schema(BLOCK).parquet(path) if fs.exists(p) else spark.createDataFrame([], BLOCK)


def _runs(spark: SparkSession, index: str, batch: int) -> DataFrame:
    """Blocks of the runs of batches before this one, numbered below 0 from the oldest."""
    out = spark.createDataFrame([], BLOCK)
    older = _history(spark, index, batch)
    for k, name in enumerate(older):
        out = out.unionByName(_blocks(spark, f"{index}/runs/{name}").withColumn("chunk", F.lit(k - len(older))))
    return out


def _settle(spark: SparkSession, index: str, batch: int, made: str, buckets: int, compact: bool) -> None:
    """Moves the batch's run, named batches from-to, and a compaction to the index; the inputs of the compaction
    before go. Runs are moved whole, so a failed job leaves the index as it was."""
    have, older = _names(spark, index), _history(spark, index, batch)
    if any(_span(n)[1] > batch for n in have):
        return
    fs, home = _fs(spark, f"{index}/runs")
    fs.mkdirs(home)

    def move(kind: str, name: str) -> None:
        _, source = _fs(spark, f"{made}/kind={kind}")
        _, target = _fs(spark, f"{index}/runs/{name}")
        fs.delete(target, True)
        if fs.exists(source):
            fs.rename(source, target)
        else:
            fs.mkdirs(target)

    if compact:
        move("compacted", f"{_span(older[0])[0]:08d}-{batch:08d}-{buckets}")
        for n in have:
            if _span(n)[1] < batch and n not in older:
                fs.delete(_fs(spark, f"{index}/runs/{n}")[1], True)
    move("new", f"{batch:08d}-{batch:08d}-{buckets}")


def in_batches(docs: DataFrame, starts: tuple[float, ...], window: int = WINDOW, fanout: int = FANOUT) -> DataFrame:
    """dedup() of docs that come in batches: ranges of doc_id that start at those shares of it (null ids come last). All but the
    last are added to a new index in the shared folder."""
    index = f"{ensure_checkpoint_dir(docs.sparkSession)}/substring-{uuid.uuid4()}"
    lo, hi, size = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long"), F.sum(F.octet_length("text"))).first()
    lo, hi = lo or 0, hi or 0
    cuts = [lo + int((hi - lo + 1) * s) for s in starts[1:]]
    of = sum(((F.col("doc_id") >= c).cast("int") for c in cuts), F.lit(0))
    of = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(of)
    out = None
    for k in range(len(starts)):
        part = dedup(docs.filter(of == k), window, index, k, add=k < len(cuts), fanout=fanout, expected=size or 0)
        out = part if out is None else out.unionByName(part)
    return out


def _digested(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches that become history, compacted, then the batch of most documents."""
    return _digested(in_batches(read(spark, sf_dir, "documents").select("doc_id", "text"), (0, 1 / 16, 1 / 8), fanout=2))


def op1_substring_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_substring's rows by way of six equal batches."""
    return _digested(in_batches(read(spark, sf_dir, "documents").select("doc_id", "text"), tuple(k / 6 for k in range(6))))


OP1_SQL = """
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS h FROM p WHERE i + 12 <= len(ws)),
o AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
hit AS (SELECT g.doc_id, i FROM g JOIN o USING (h) WHERE g.doc_id > least),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM hit),
k AS (SELECT p.doc_id, count(*) AS n, string_agg(p.ws[p.i], ' ' ORDER BY p.i) AS kept FROM p ANTI JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
