"""SimHash near-duplicates by their sets of word shingles: one document of each component stays.

Two texts are linked if the Jaccard similarity of their sets of shingles (lower case, a text of fewer words
is one shingle) is at least the limit. First come the pairs that the pivot distance tables of ``simhash.py`` find among
fingerprints of these shingles; they are checked on the texts. But the distance of two fingerprints doesn't bound
similarity: at 0.8 it is 10 of 64 bits in the mean, and tables for so many bits would hold each fingerprint thousands of
times. So pairs of the components left come from prefixes of the sets, which miss none:
in a common order of all shingles, rare ones first, two such sets share one of the first n - ceil(limit * n) + 1 of
each. The order is by counts in a sample of documents, then by hash; whatever it is, no pair is missed.
Sets that are equal become one first. The sets with a common shingle stand in a bucket by size. The first round checks,
beside the fingerprints' pairs, neighbours; each later one goes WIDER times as far, from members outside the bucket's
largest component to those of other components, and takes only buckets where some are left, until none are. So a member of a large
group of near copies is joined to it by a few pairs before it would meet all of it. Lengths, positions, sketches
of sets up to SKETCHED and bitmaps (each shingle flips one bit, so two differ in no more bits than the sets in shingles) discard
pairs that can't reach the limit, sketches in the bucket, before a pair is made; the rest are checked on their texts, of which
only those wanted move. Hash equality (64 bits) stands for equality of shingles and sets.

Rows: null, empty and wordless texts have the empty set and are equal. Of ties, texts of one component under the
least id, the one with the least hash stays; of rows that repeat an id and a text, one. A row with a null id stays only if
no other id is in its component. Very long texts are compared whole. An empty table gives no rows. Columns are taken by
name, the first of those that clash, and all are returned as they are.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import PARTS_SQL, grams, rows_of
from .common import checkpoint, chunks, flat, gathered, id_array, mix, pack, partitions, pick, position, released, to_part, unpack
from .components import components
from .simhash import LOWER, fingerprints, near_fingerprints

#: One document of so many is sampled for the order; shingles in COMMON of them or more come last; so many are told apart.
SAMPLE, COMMON, TOLD = 64, 4, 100_000
#: Bits of the filter of wanted texts.
SLOTS = 1 << 25
#: Least bits of a set's bitmap, which has at least two for each shingle.
MAP = 64
#: Bits of the sketch that sets of at most so many shingles take along to their buckets; larger ones would fill it.
SKETCH, SKETCHED = 256, 384
#: How many times as far each round goes in a bucket.
WIDER = 8
#: Sets that a task remembers while it checks pairs.
REMEMBER = 2000


def shingle_set(text: bytes, words: int) -> np.ndarray:
    w = text.translate(LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), words)], np.uint64)
    return np.unique(mix(grams(np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)), words)))


def _needed(n, limit: Fraction):
    """The least whole number that is limit * n or more."""
    return -(-n * limit.numerator // limit.denominator)


def prefix(s: np.ndarray, limit: Fraction, told: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set in the common order."""
    m = len(s) - _needed(len(s), limit) + 1 if len(s) else 0
    if len(told) and len(s):
        at = np.minimum(np.searchsorted(told, s), len(told) - 1)
        s = s[np.argsort(np.where(told[at] == s, rank[at], 0), kind="stable")]
    return s[:m]


def bitmap(s: np.ndarray) -> bytes:
    bits = max(MAP, 1 << (2 * len(s) - 1).bit_length()) if len(s) else MAP
    return np.packbits(np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1 == 1).tobytes()


def sketch(s: np.ndarray) -> bytes:
    """A bitmap of SKETCH bits, whatever the size of the set; zeros for one that is too large."""
    few = s if len(s) <= SKETCHED else s[:0]
    return np.packbits(np.bincount((few % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1 == 1).tobytes()


def differ(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ, the longer folded to the length of the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) != len(y):
        n = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(z.reshape(-1, n)) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _sampled(words: int):
    @released
    def run(batches):
        for chunk in chunks(batches, 4 << 20):
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(shingle_set(t, words) for t in chunk.texts())]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

    return run


def _sets(words: int, limit: Fraction, told: np.ndarray, rank: np.ndarray):
    @released
    def run(batches):
        for chunk in chunks(batches, 4 << 20):
            sets = [shingle_set(t, words) for t in chunk.texts()]
            sid = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            first = [prefix(s, limit, told, rank).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([id_array(chunk.ids), chunk.column(2).cast(pa.int64()), pa.array(sid), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.binary()), pa.array([bitmap(s) for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array(fingerprints(chunk.texts(), words).view(np.int64))], names=["doc_id", "code", "sid", "size", "prefix", "map", "sketch", "fp"])

    return run


def _to_buckets(parts: int, sketched: bool):
    @released
    def run(batches):
        for b in batches:
            first = [np.frombuffer(x, np.uint64) for x in b.column(2).to_pylist()]
            m = np.array([len(x) for x in first], np.int64)
            if not m.sum():
                continue
            token = np.concatenate(first)
            doc = np.repeat(np.arange(len(m)), m)
            pos = (np.arange(len(doc)) - np.repeat(np.cumsum(m) - m, m)).astype(np.int32)
            sid, comp = (b.column(i).to_numpy() for i in (0, 3))
            size = b.column(1).to_numpy().astype(np.int32)
            # the whole hash names a shingle's bucket, so strangers don't meet however many shingles there are
            key = token
            part = (mix(key) % np.uint64(parts)).astype(np.int64)
            same = bool((sid == comp).all())
            bits = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint64).reshape(-1, SKETCH // 64) if sketched else None
            yield from rows_of(part, 0, lambda i: (key[i], sid[doc[i]], size[doc[i]], pos[i], None if same else comp[doc[i]], bits[doc[i]] if sketched else None))  # noqa: B023

    return run


def _outside(key: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Whether each member is outside the largest component of its bucket; keys are sorted."""
    bucket = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    _, code = np.unique(comp, return_inverse=True)
    both = bucket * (int(code.max(initial=0)) + 1) + code
    values, back, n = np.unique(both, return_inverse=True, return_counts=True)
    of = values // (int(code.max(initial=0)) + 1)
    order = np.lexsort((n, of))
    largest = order[np.r_[of[order][1:] != of[order][:-1], True]]  # of each bucket
    return both != values[largest][bucket]


def candidates(key, sid, size, pos, comp, limit: Fraction, every: bool, after: int = 0, until: int | None = None, bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with a common key, of different components, that may reach the limit: neighbours by size, or all
    that stand more than `after` and at most `until` places apart."""
    order = np.lexsort((pos, sid, size, key))
    key, sid, size, pos, comp = key[order], sid[order], size[order].astype(np.int64), pos[order].astype(np.int64), comp[order]
    bits = None if bits is None else bits[order]
    both = limit / (1 + limit)
    out = [np.zeros((0, 2), np.int64)]
    if len(key):
        outside = _outside(key, comp) if every else np.ones(len(key), bool)
        for way in (1, -1) if every else (1,):
            i = np.flatnonzero(outside)
            step = after + 1
            while len(i) and (until is None or step <= until):
                j = i + way * step
                ok = (j >= 0) & (j < len(key))
                i, j = i[ok], j[ok]
                low, high = (i, j) if way > 0 else (j, i)
                # sizes ascend in a bucket, so once too far apart, always too far
                ok = (key[i] == key[j]) & (size[low] * limit.denominator >= size[high] * limit.numerator)
                i, j = i[ok], j[ok]
                rest = np.minimum(size[i] - pos[i], size[j] - pos[j])
                fit = (comp[i] != comp[j]) & (rest >= _needed(size[i] + size[j], both))
                if way < 0:
                    fit &= ~outside[j]
                x, y = i[fit], j[fit]
                if bits is not None and len(x):
                    n = size[x] + size[y]
                    far = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) > n - 2 * _needed(n, both)
                    fit = ~far | (np.maximum(size[x], size[y]) > SKETCHED)
                    x, y = x[fit], y[fit]
                if len(x):
                    a, b = sid[x], sid[y]
                    out.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
                    if len(out) > 200:
                        out = [np.unique(np.concatenate(out), axis=0)]
                if not every:
                    break
                step += 1
    got = np.unique(np.concatenate(out), axis=0)
    return got[:, 0], got[:, 1]


def left(key, sid, size, comp, limit: Fraction, after: int) -> np.ndarray:
    """All sets of the buckets where a member outside the largest component has others in reach by size more than so
    many places away."""
    order = np.lexsort((sid, size, key))
    key, sid, size, comp = key[order], sid[order], size[order].astype(np.int64), comp[order]
    at = np.flatnonzero(_outside(key, comp)) if len(key) else np.zeros(0, np.int64)
    buckets = [key[:0]]
    for way in (1, -1):
        i, j = at, at + way * (after + 1)
        ok = (j >= 0) & (j < len(key))
        i, j = i[ok], j[ok]
        low, high = (i, j) if way > 0 else (j, i)
        buckets.append(key[i[(key[i] == key[j]) & (size[low] * limit.denominator >= size[high] * limit.numerator)]])
    return np.unique(sid[np.isin(key, np.concatenate(buckets))])


def _pairs(limit: Fraction, after: int, until: int):
    """Pairs that stand so many places apart, and (sid, sid) of each set of a bucket where some are left."""

    @released
    def run(batches):
        got = [unpack(x.as_py()) for b in batches for x in b.column(2)]
        if not got:
            return
        key, sid, size, pos = (np.concatenate([g[c] for g in got]) for c in range(4))
        comp = np.concatenate([g[1] if g[4] is None else g[4] for g in got])
        bits = None if got[0][5] is None else np.concatenate([g[5] for g in got])
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        many = n[back] > 1
        key, sid, size, pos, comp = key[many], sid[many], size[many], pos[many], comp[many]
        a, b = candidates(key, sid, size, pos, comp, limit, after > 0, after, until, None if bits is None else bits[many])
        more = left(key, sid, size, comp, limit, until)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[a, more]), pa.array(np.r_[b, more])], names=["u", "v"])

    return run


def _may_reach(limit: Fraction):
    @released
    def run(batches):
        for b in batches:
            su, sv = (b.column(i).to_numpy() for i in (2, 4))
            bits = np.fromiter((differ(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True)), np.int64, b.num_rows)
            fit = pa.array(bits <= su + sv - 2 * _needed(su + sv, limit / (1 + limit)))
            yield pa.RecordBatch.from_arrays([b.column(i).filter(fit) for i in (0, 1, 6, 7)], names=["u", "v", "ku", "kv"])

    return run


def _wanted(bits: np.ndarray, words: int):
    @released
    def run(batches):
        for b in batches:
            slot = b.column(2).to_numpy()
            texts = [t.encode() for t in b.column(1).filter(pa.array((bits[slot >> 6] >> (slot & 63)) & 1 == 1)).to_pylist()]
            sid = np.array([xxhash.xxh3_64_intdigest(shingle_set(t, words).tobytes()) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array([pack(t) for t in texts], pa.binary())], names=["sid", "t"])

    return run


def _check(words: int, limit: Fraction):
    @released
    def run(batches):
        known: dict[int, np.ndarray] = {}
        for b in batches:
            u, v = (b.column(i).to_numpy() for i in (0, 1))
            good = np.zeros(len(u), bool)
            for i in range(len(u)):
                s = []
                for x, texts in ((u[i], 2), (v[i], 3)):
                    if x not in known:
                        if len(known) >= REMEMBER:
                            known.clear()
                        known[x] = shingle_set(unpack(b.column(texts)[i].as_py()), words)
                    s.append(known[x])
                common = len(np.intersect1d(*s, assume_unique=True))
                good[i] = common * limit.denominator >= (len(s[0]) + len(s[1]) - common) * limit.numerator
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["u", "v"])

    return run


def _verified(rows: DataFrame, least: DataFrame, pairs: DataFrame, words: int, limit: Fraction) -> DataFrame:
    """The pairs that reach the limit; what a pair's first rows are comes along with the bitmaps, so texts are asked for without another join."""
    slot = lambda k, code: F.pmod(F.xxhash64(k, code), F.lit(SLOTS))
    side = lambda x: least.select(F.col("sid").alias(x), F.col("size").alias(f"s{x}"), F.col("map").alias(f"m{x}"), slot("least.doc_id", "least.code").alias(f"k{x}"))
    maps = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "su", "mu", "sv", "mv", "ku", "kv")
    pairs = gathered(maps.mapInArrow(_may_reach(limit), "u long, v long, ku long, kv long"))
    marks = pairs.select(F.explode(F.array("ku", "kv")).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toArrow()
    bits = np.zeros(SLOTS >> 6, np.int64)  # at most so many rows, however many texts are wanted
    bits[marks.column(0).to_numpy()] = marks.column(1).to_numpy()
    # a few unwanted texts come along and join nothing; one that comes twice makes its links twice
    texts = checkpoint(rows.select("k", "t", slot("k", "code").alias("slot")).mapInArrow(_wanted(bits, words), "sid long, t binary"))
    sides = pairs.join(texts.withColumnsRenamed({"sid": "u", "t": "tu"}), "u").join(texts.withColumnsRenamed({"sid": "v", "t": "tv"}), "v")
    return sides.select("u", "v", "tu", "tv").mapInArrow(_check(words, limit), "u long, v long")


def _alike(least: DataFrame, parts: int) -> DataFrame:
    """Pairs of sets whose fingerprints are equal or near, each fingerprint with the set of least hash for all of its sets."""
    one = least.groupBy("fp").agg(F.min("sid").alias("v"))
    same = least.select(F.col("sid").alias("u"), "fp").join(one, "fp").where("u <> v").select("u", "v")
    near = near_fingerprints(one, least.count(), parts, forest=False)
    of = lambda x: one.select(F.col("fp").alias(x), F.col("v").alias(f"of_{x}"))
    pairs = near.join(of("u"), "u").join(of("v"), "v").select(F.col("of_u").alias("u"), F.col("of_v").alias("v"))
    return same.union(pairs).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (k, t, code), and for each set (sid, root, least): its component's name and its first row."""
    limit = Fraction(str(similarity))
    rows = pick(docs, k=(id_col, "long"), t=(text_col, "string")).select("k", F.coalesce("t", F.lit("")).alias("t"), F.xxhash64("t").alias("code"))
    n = partitions(rows, 64 << 20)
    common = rows.where(F.pmod("code", F.lit(SAMPLE)) == 0).mapInArrow(_sampled(words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(TOLD).toArrow()
    told, rank = common.column(0).to_numpy().view(np.uint64), common.column(1).to_numpy()
    order = np.argsort(told)
    marked = rows.mapInArrow(_sets(words, limit, told[order], rank[order]), "doc_id long, code long, sid long, size long, prefix binary, map binary, sketch binary, fp long")
    least = checkpoint(marked.groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "code")).alias("least"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("map").alias("map"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp")))

    def pairs(nodes: DataFrame, after: int, until: int) -> DataFrame:
        sent = nodes.select("sid", "size", "prefix", "comp", *(["sketch"] if after else []))
        return gathered(to_part(n, sent.mapInArrow(_to_buckets(n, after > 0), PARTS_SQL), "part").mapInArrow(_pairs(limit, after, until), "u long, v long").distinct())

    after, until = 0, 1
    near = pairs(least.withColumn("comp", F.col("sid")), after, until)
    tied = components(_verified(rows, least, near.where("u <> v").union(_alike(least, n)).distinct(), words, limit))
    while not (open_ := near.where("u = v").select(F.col("u").alias("sid"))).isEmpty():
        after, until = until, until * WIDER
        named = tied.withColumnsRenamed({"node": "sid", "root": "comp"})
        # buckets with pairs left come whole, so places in them stay; in others pairs that were seen may come again
        nodes = least.select("sid", "size", "prefix", "sketch").join(open_, "sid", "left_semi").join(named, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        near = pairs(nodes, after, until)
        wanted = near.where("u <> v")
        if not wanted.isEmpty():
            tied = components(tied.select(F.col("node").alias("u"), F.col("root").alias("v")).union(_verified(rows, least, wanted, words, limit)))
    return rows, least.join(tied.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), "least")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns as they are, of one document of each component: that of the smallest id.
    Of rows that repeat its id and text one stays."""
    marked, of = _grouped(docs, id_col, text_col, words, similarity)
    first = of.groupBy("root").agg(F.min("least").alias("first")).select(F.col("first.doc_id").alias("k"), F.col("first.code").alias("code"))
    plain, names = flat(docs)
    rows = plain.withColumns({"__k": F.col(f"__c{position(names, id_col)}").cast("long"), "__code": F.xxhash64(F.col(f"__c{position(names, text_col)}").cast("string"))})
    kept = rows.join(first.hint("shuffle_hash"), rows["__k"].eqNullSafe(first["k"]) & (rows["__code"] == first["code"]), "left_semi")
    # repeated rows are looked for by their keys alone, so that texts move again only where there are some
    if marked.groupBy("k", "code").count().where("count > 1").isEmpty():
        return kept.drop("__k", "__code").toDF(*names)
    return kept.dropDuplicates(["__k", "__code"]).drop("__k", "__code").toDF(*names)
