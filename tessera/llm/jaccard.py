"""Size-aware heavy-light Jaccard join of documents by word n-grams, and its groups.

Small sets are enumerated: two sets link if and only if they share a subset of the size of the overlap they need, so
every set lists its subsets of the few sizes that its possible partners ask for. Large sets are scanned in inverted
lists: linked sets of sizes n and m differ in at most (n + m)(1 - t)/(1 + t) members; hashed into more parts than that,
some part of theirs is the same, so each set enters the list of each of its parts. Parts are made per class of size, and
a set enters those of its own class and the next. The boundary is where enumerating costs more than scanning.

Equal sets are collapsed first, so copies make no pairs. The FEW smallest signatures of every set find most links: the
sets of such a signature are held against its first one. What these groups leave is found by the whole lists: a short list
gives its pairs of different groups, a long one those with its first member; what is still apart is compared in later
rounds, in the lists whose members are of several groups, a pair of blocks of a list a task, until no pair of a list is
untested. Pairs are first held against parity sketches (they differ in no more bits than the sets differ in members:
nothing is lost), then counted exactly.

Defined results: words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text of fewer words than n makes one n-gram of
them all; texts that are null or without words have empty sets and link with nothing; a null id links with nothing and
has no component; rows of one id are texts of one document, which links what any of them links; repeated rows give a row
each; an empty table gives an empty result; other columns are ignored. n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations
from math import comb, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NARROW_ROWS, cut, lookup, read, small_batches
from .components import components
from .packed import CHUNK_BYTES, get, get_small, put, put_small, split_by_bucket, text_bytes
from .words import WordHash, grams, mix64, portions

#: Lists of up to so many sets give all pairs at once; of a longer one, so many sets are a block.
SHORT, BLOCK = 6, 2048
#: Signatures of a set that are looked at before the whole lists.
FEW = 8
#: What scanning an entry of an inverted list costs, in enumerated subsets.
SCAN_COST = 8
#: Least and most bits of a parity sketch; in between two to four per member, so that unlike sets of any size differ in it.
SKETCH_BITS = (256, 1 << 16)
TRIES = 8
#: Signatures that a task gathers before it sorts and sends them, and pairs whose sets it holds as Python objects.
SENT, HELD = 1 << 19, 512
_HASHES = WordHash()


@dataclass(frozen=True)
class Join:
    """n-gram length, and the similarity as a fraction: link if den * intersection >= num * union."""

    words: int = 3
    num: int = 90
    den: int = 100

    def overlap(self, n: int, m: int) -> int:
        """The least intersection that links sets of these sizes."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def differ(self, both: int) -> int:
        """The most members in which linked sets of so many members together differ."""
        return (self.den - self.num) * both // (self.den + self.num)

    def subset_sizes(self, n: int) -> list[int]:
        return sorted({t for m in range(self.num * n // self.den, self.den * n // self.num + 1) if 0 < (t := self.overlap(n, m)) <= min(n, m)})

    @cached_property
    def light(self) -> int:
        """The largest size that is enumerated: the first size whose subsets cost more than its list entries ends it."""
        n = 1
        while sum(comb(n, t) for t in self.subset_sizes(n)) <= (1 + SCAN_COST) * 2 * (self.differ(2 * n) + 1):
            n += 1
        return n - 1

    @cached_property
    def edges(self) -> np.ndarray:
        """Least sizes of the classes of large sets; linked sets are in one class or in neighbours."""
        out = [max(1, self.num * (self.light + 1) // self.den)]
        while out[-1] < 1 << 40:
            out.append(self.den * out[-1] // self.num + 1)
        return np.array(out)

    @cached_property
    def parts(self) -> np.ndarray:
        """Per class: parts (one more than linked sets can differ in, and the slack), and the empty parts allowed. The slack
        suits the smallest sets that enter, those of the class before."""
        rows = []
        for i, (low, high) in enumerate(zip(self.edges, self.edges[1:])):
            k = self.differ(2 * (int(high) - 1)) + 1
            lam = k * exp(-int(self.edges[i - 1] if i else low) / k)
            slack = int(lam + 3 * sqrt(lam) + 1)
            rows.append((k + slack, slack))
        return np.array(rows)


def shingles(text: bytes, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(grams(_HASHES.hashes(words), min(n, len(words))))


def sketch(s: np.ndarray) -> bytes:
    """Parities of the members' places modulo a power of two."""
    bits = min(max(1 << (2 * len(s)).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    return np.packbits(np.bincount((mix64(s) % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer 64-bit words: halves are added modulo 2, which gives the sketch of that size."""
    while x.shape[-1] > words:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def signatures(sets: list[np.ndarray], join: Join, alike: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(signature, position of its set), for non-empty sets. alike: only those that sets of about the same size share."""
    sig, who = [], []
    size = np.array([len(s) for s in sets], np.int64)
    for i in np.flatnonzero((size > 0) & (size <= join.light)).tolist():
        member = mix64(sets[i] + np.uint64(0x51ED27))
        for t in [join.overlap(len(member), len(member))] if alike else join.subset_sizes(len(member)):
            gone = np.array(list(combinations(range(len(member)), len(member) - t)), np.int64)
            total = member.sum() - (member[gone].sum(axis=1) if gone.size else np.zeros(1, np.uint64))
            sig.append(mix64(total * np.uint64(2) + np.uint64(t)))
            who.append(np.full(len(total), i))
    heavy = np.flatnonzero(size >= join.edges[0])
    for step in (0,) if alike else (0, 1):
        left = heavy
        for attempt in range(TRIES + 1):
            if not len(left):
                break
            label = np.searchsorted(join.edges, size[left], side="right") - 1 + step
            k, slack = join.parts[label].T
            member, n = np.concatenate([sets[i] for i in left.tolist()]), size[left]
            salt = mix64((label * 64 + attempt).astype(np.uint64))
            first = np.cumsum(k) - k
            part = (mix64(member + np.repeat(salt, n)) % np.repeat(k, n).astype(np.uint64)).astype(np.int64) + np.repeat(first, n)
            total, count = np.zeros(int(k.sum()), np.uint64), np.bincount(part, minlength=int(k.sum()))
            np.add.at(total, part, mix64(member ^ np.repeat(salt, n)))
            of = np.repeat(np.arange(len(left)), k)
            empty = np.bincount(of[count == 0], minlength=len(left))
            say = (count > 0) | (attempt == TRIES)
            number = np.arange(len(of)) - first[of]
            sig.append(mix64(total + mix64(number.astype(np.uint64) + salt[of]))[say])
            who.append(left[of[say]])
            left = left[empty > slack]  # else the shared part could be an empty one: another hash as well
    return (np.concatenate(sig), np.concatenate(who)) if sig else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _linked(a: np.ndarray, n: int, b: np.ndarray, m: int, join: Join) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return join.den * both >= join.num * (n + m - both)


def _near(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, join: Join) -> np.ndarray:
    """Whether sizes and sketches (of one length) allow a link."""
    bits = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    return (bits <= (join.den - join.num) * (n + m) // (join.den + join.num)) & (join.den * np.minimum(n, m) >= join.num * np.maximum(n, m))


def _pairs(bucket: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Pairs of sets of different groups in the lists of a bucket, and the members of its long lists."""
    blocks = list(zip(*(bucket[c].to_pylist() for c in ("keys", "ids", "roots"))))
    sig = np.concatenate([get(k) for k, _, _ in blocks])
    who = np.concatenate([get_small(i, int.from_bytes(k[:4], "little")) for k, i, _ in blocks]).astype(np.int64)
    root = np.concatenate([_roots_in(r, get_small(i, int.from_bytes(k[:4], "little")).astype(np.int64)) for k, i, r in blocks])
    order = np.argsort(sig, kind="stable")
    sig, who, root = sig[order], who[order], root[order]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(start, len(sig)))
    a, b, long = [], [], []
    for n in range(2, SHORT + 1):
        at = start[size == n][:, None] + np.arange(n)
        rows, of = who[at], root[at]
        for i, j in combinations(range(n), 2):
            apart = of[:, i] != of[:, j]
            a.append(rows[apart, i])
            b.append(rows[apart, j])
    seen = set()
    for s, n in zip(start[size > SHORT].tolist(), size[size > SHORT].tolist()):
        ids, at = np.unique(who[s : s + n], return_index=True)
        of = root[s : s + n][at]
        far = of != of[0]
        if not far.any():
            continue
        raw = ids.tobytes()
        h = xxhash.xxh3_128_digest(raw)
        if h not in seen:
            seen.add(h)
            long.append(raw)
            a.append(np.full(int(far.sum()), ids[0]))
            b.append(ids[far])
    a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    pair = pair[pair[:, 0] != pair[:, 1]]
    return pair[:, 0], pair[:, 1], long


def _roots_out(ids: np.ndarray, roots: np.ndarray) -> bytes:
    """Groups of ids: a bit where it isn't the id itself, then those groups."""
    other = ids != roots
    return np.packbits(other).tobytes() + put_small(roots[other].astype(np.uint64)) if other.any() else b""


def _roots_in(raw: bytes, ids: np.ndarray) -> np.ndarray:
    out = ids.copy()
    if raw:
        n = -(-len(ids) // 8)
        other = np.unpackbits(np.frombuffer(raw, np.uint8, n), count=len(ids)).astype(bool)
        out[other] = get_small(raw[n:], int(other.sum())).astype(np.int64)
    return out


def _few(sig: np.ndarray, who: np.ndarray, n: int) -> list[bytes]:
    """Of each of n sets the FEW smallest signatures."""
    order = np.lexsort((sig, who))
    sig, who = sig[order], who[order]
    start = np.searchsorted(who, np.arange(n))
    place = np.arange(len(who)) - start[who]
    keep = place < FEW
    edges = np.searchsorted(who[keep], np.arange(n + 1))
    kept = sig[keep].view(np.int64)
    return [kept[s:e] for s, e in zip(edges[:-1], edges[1:])]


def few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, HELD) for batch in batches for at in range(0, batch.num_rows, HELD))


def listed(batch: pa.RecordBatch, join: Join, buckets: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text, root -> blocks of the documents' signatures by bucket. Sets are held a portion at a time."""
    ids, roots = batch.column(0).to_numpy(), batch.column(2).to_numpy()
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for at, body in portions(batch.column(1)):
        sig, who = signatures([shingles(t, join.words) for t in body], join)
        parts.append((sig, at + who))
        if at + len(body) < len(ids) and sum(len(s) for s, _ in parts) < SENT:
            continue
        sig, who = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.argsort(sig)
        sig, who = sig[order], who[order]
        rows = [(b, put(sig[s:e]), put_small(ids[who[s:e]].astype(np.uint64)), _roots_out(ids[who[s:e]], roots[who[s:e]])) for b, s, e in split_by_bucket(sig, buckets)]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.binary()] * 3))], names=["bucket", "keys", "ids", "roots"])


def groups(docs: DataFrame, join: Join = Join(), chunk_bytes: int = CHUNK_BYTES, block: int = BLOCK) -> DataFrame:
    """docs: doc_id, text -> doc_id, n_shingles, component_id (the smallest id reachable by links).

    Every step in Python runs before this returns, in small batches, so that a worker never holds thousands of texts."""
    with small_batches(docs.sparkSession):
        return _groups(docs, join, chunk_bytes, block)


def _groups(docs: DataFrame, join: Join, chunk_bytes: int, block: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = max(16, -(-text_bytes(docs)[1] // chunk_bytes))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, body in portions(batch.column(1)):
                sets = [shingles(t, join.words) for t in body]
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                few = _few(*signatures(sets, join, alike=True), len(sets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array(few, pa.list_(pa.int64()))], names=["doc_id", "n", "digest", "sketch", "few"])

    def list_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from listed(batch, join, buckets)

    def scan(key: tuple, bucket: pa.Table) -> pa.Table:
        a, b, long = _pairs(bucket)
        none = [None] * len(long)
        return pa.table({"a": pa.array([*a.tolist(), *none], pa.int64()), "b": pa.array([*b.tolist(), *none], pa.int64()), "members": pa.array([*[None] * len(a), *long], pa.binary())})

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(raw)] * len(ids), pa.binary()), pa.array(ids, pa.int64())], names=["list", "rep"])

    def between(key: tuple, rows: pa.Table) -> pa.Table:
        """Pairs of sets of two blocks of a list (or of one) that are of different groups and whose sketches allow a link."""
        rows = rows.combine_chunks().sort_by([("block", "ascending"), ("rep", "ascending")])
        rep, root, n, part = (rows[c].to_numpy() for c in ("rep", "root", "n", "block"))
        sketches = [np.frombuffer(r, np.uint64) for r in rows["sketch"].to_pylist()]
        x = np.stack([folded(r, min(map(len, sketches))) for r in sketches])
        first = np.searchsorted(part, key[2].as_py()) if key[1].as_py() != key[2].as_py() else 0
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(first or len(rep) - 1):
            begin = first or i + 1
            far = np.flatnonzero(root[begin:] != root[i]) + begin
            far = far[_near(x[i], n[i], x[far], n[far], join)] if len(far) else far
            a.append(np.minimum(rep[i], rep[far]))
            b.append(np.maximum(rep[i], rep[far]))
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            near = []
            for a, n, b, m in zip(*(batch[c].to_pylist() for c in ("xa", "na", "xb", "nb"))):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                words = min(len(x), len(y))
                near.append(bool(_near(folded(x, words), n, folded(y, words), m, join)))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def collect_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, body in portions(batch.column(1)):
                sets = [shingles(t, join.words) for t in body]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([put(s) for s in sets], pa.binary())], names=["doc_id", "n", "members"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            good = [_linked(get(x), n, get(y), m, join) for x, n, y, m in zip(*(batch[c].to_pylist() for c in ("sa", "na", "sb", "nb")))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    told = cut(docs.mapInArrow(describe, "doc_id long, n long, digest binary, sketch binary, few array<long>"))
    first = told.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    known = cut(told.join(first, "digest", "left").select("doc_id", "n", "sketch", "few", "rep"))
    of_rep = known.filter("rep = doc_id").select("rep", "n", "sketch", "few").dropDuplicates(["rep"])
    sketched = of_rep.drop("few")

    def possible(pairs: DataFrame) -> DataFrame:
        return cut(pairs.join(sketched.toDF("a", "na", "xa"), "a").join(sketched.toDF("b", "nb", "xb"), "b").mapInArrow(sieve, "a long, b long"))

    def linked(pairs: DataFrame) -> DataFrame:
        asked = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        sets = cut(lookup(docs, asked, ["doc_id"], asked.count(), most=NARROW_ROWS).mapInArrow(collect_sets, "doc_id long, n long, members binary"))
        return pairs.join(sets.toDF("a", "na", "sa"), "a").join(sets.toDF("b", "nb", "sb"), "b").mapInArrow(verify, "a long, b long").distinct()

    # texts of one id belong together
    several = known.filter("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z")
    links = several.join(known, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b"))
    # few signatures find most links; whole lists then only have to find what is still apart
    few = of_rep.select(F.explode("few").alias("sig"), "rep")
    shared = few.groupBy("sig").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z").select("sig", "a")
    tested = possible(few.join(shared, "sig").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct())
    links = cut(links.union(linked(tested)))
    roots = cut(components(links))
    moved = known.filter("rep is not null").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    moved = moved.groupBy("doc_id").agg(F.bool_or(F.col("rep") == F.col("doc_id")).alias("own"), F.min(F.coalesce("component", "rep")).alias("root")).filter("not own or root <> doc_id")
    moved = cut(moved)
    each = lookup(docs.filter("doc_id is not null"), moved, ["doc_id"], moved.count(), "left", most=NARROW_ROWS).filter("coalesce(own, true)")
    each = each.select("doc_id", "text", F.coalesce("root", "doc_id").alias("root"))
    lists = cut(each.mapInArrow(list_up, "bucket int, keys binary, ids binary, roots binary").groupBy("bucket").applyInArrow(scan, "a long, b long, members binary"))
    pairs = possible(lists.filter("a is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
    held = cut(lists.filter("members is not null").select("members").mapInArrow(members, "list binary, rep long").distinct())
    while not pairs.isEmpty():
        links, tested = cut(links.union(linked(pairs))), tested.union(pairs)
        roots = cut(components(links))
        open_ = held.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("list", "rep", F.coalesce("component", "rep").alias("root"))
        size = open_.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / block).alias("blocks")).filter("lo <> hi")
        held = cut(open_.join(size.select("list", "blocks"), "list"))
        if held.isEmpty():
            break
        met = held.join(sketched, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        met = met.select("list", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "root", "n", "sketch")
        pairs = cut(met.groupBy("list", "lo", "hi").applyInArrow(between, "a long, b long").distinct().join(tested, ["a", "b"], "left_anti"))
        held = held.select("list", "rep")
    roots = roots.withColumnRenamed("id", "rep")
    return known.join(roots, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"))


OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, h FROM (
  SELECT doc_id, md5(array_to_string(ws[i:i + 2], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
df AS (SELECT h, count(*) AS df FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM (SELECT * FROM g SEMI JOIN df USING (h)) a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m USING (doc_id)
"""
