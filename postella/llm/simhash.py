"""SimHash near-duplicates with pivot distance tables.

Fingerprints that are equal become one first, so copies cost nothing afterwards. Fingerprints that
differ in at most four of 64 bits agree in all but four of m blocks; for each choice of m - 4 blocks a fingerprint goes
to the bucket of its bits there. m is the least from six on with which a bucket of fingerprints that have
nothing to do with each other is small; so keys get longer as rows get more. In every bucket, distances
of all members to reference fingerprints are precomputed. Members outside the component of the first are compared with the
bucket one after another: those whose distances to a reference differ by more than the limit can't be near
(triangle inequality) and are discarded, survivors are verified bit by bit. What is in one component already isn't
compared any more, so a bucket of near copies of one text, however many, takes few rounds over its members.
Each task sends only a spanning forest of its links; components are found by star contraction.

Rows: one per document row. A null, empty or wordless text has fingerprint zero and links like any other. A
null id is never the component's name unless no other id is in it. Rows that repeat an id, and ties among ids, are
each in their own text's component. A very long text is hashed whole, STEP words at a time. An empty table gives no
rows. Columns are taken by name, the first of those that clash; others don't matter, and `keep_one` returns all.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import PARTS_SQL, rows_of
from .common import checkpoint, chunks, flat, id_array, mix, partitions, pick, position, released, to_part, unpack
from .components import components, local_components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles hashed at once.
STEP = 1 << 18
BITS = 4
#: Reference fingerprints.
PIVOTS = mix(np.arange(1, 33, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Fingerprints that a bucket holds by chance, at most.
CROWD = 32
#: Places to which a component's members are dealt when they learn its name.
SALTS = 16
#: A fingerprint is hot with more rows than this, and than one in HOT_SHARE of all.
HOT_LEAST, HOT_SHARE = 256, 4096
#: Rounds with one reference member for each bucket; members compared together in later ones; pairs held at once.
SINGLY, TOGETHER, PAIRS = 8, 256, 1 << 22


def tables(rows: int) -> list[np.uint64]:
    """Masks of the bits by which buckets are made for so many fingerprints: all but four of m blocks."""
    m = next(m for m in range(BITS + 2, 64) if m == 12 or rows >> (64 * (m - BITS) // m) <= CROWD)
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(m)]
    return [np.uint64(sum(c)) for c in combinations(blocks, m - BITS)]


def _ones(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the hashes of each piece (they begin at `at`) have each bit: (pieces, 64)."""
    out = np.zeros((len(at), 64), np.int64)
    for byte in range(8):
        bits = np.unpackbits(((h >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)[:, None], axis=1, bitorder="little")
        for bit in range(8):
            out[:, 8 * byte + bit] = np.add.reduceat(np.ascontiguousarray(bits[:, bit]), at, dtype=np.int64)
    return out


def fingerprints(texts: list[bytes], shingle: int = 4) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    group: list[tuple[int, int]] = []  # text, shingles
    every: list[bytes] = []
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def hashed() -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in every), np.uint64, len(every))

    def finish() -> None:
        if group:
            which, sizes = (np.array(x, np.int64) for x in zip(*group, strict=True))
            ones = _ones(hashed(), np.cumsum(sizes) - sizes)
            out[which] = np.where(2 * ones > sizes[:, None], bit, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        group.clear()
        every.clear()

    for i, t in enumerate(texts):
        w = t.translate(LOWER).split()
        m = max(len(w) - shingle + 1, min(len(w), 1))
        if m > STEP:
            finish()
            ones = np.zeros(64, np.int64)
            for lo in range(0, m, STEP):
                part = w[lo : lo + STEP + shingle - 1]
                every += map(b" ".join, zip(*[part[j:] for j in range(shingle)], strict=False))
                ones += _ones(hashed(), np.zeros(1, np.int64))[0]
                every.clear()
            out[i] = np.where(2 * ones > m, bit, np.uint64(0)).sum(dtype=np.uint64)
        elif m:
            if len(w) <= shingle:
                every.append(b" ".join(w))
            else:
                every += map(b" ".join, zip(*[w[j:] for j in range(shingle)], strict=False))
            group.append((i, m))
            if len(every) > STEP:
                finish()
    finish()
    return out


def _fingerprint(batches):
    names = ["doc_id", "code", "fp"]
    for chunk in chunks(batches, 4 << 20):
        yield pa.RecordBatch.from_arrays([id_array(chunk.ids), chunk.column(2).cast(pa.int64()), pa.array(fingerprints(chunk.texts()).view(np.int64))], names=names)


def _to_buckets(masks: list[np.uint64], parts: int):
    @released
    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            if not len(fp):
                continue
            table = np.repeat(np.arange(len(masks), dtype=np.uint16), len(fp))
            key = np.concatenate([fp & m for m in masks])
            every = np.tile(fp, len(masks))
            part = (mix(key + table * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)
            yield from rows_of(part, 0, lambda i: (table[i], every[i]))  # noqa: B023

    return run


def bucket_links(bucket: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions in one bucket (equal numbers stand together) with at most BITS differing bits, enough of them
    to hold together whatever such pairs connect."""
    n = len(fp)
    far = [np.bitwise_count(fp ^ p).astype(np.int8) for p in PIVOTS]
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, n])
    root = np.arange(n)
    asked = np.zeros(n, bool)
    a, b = [], []
    start, size = start[size > 1], size[size > 1]
    rounds = 0
    while len(start):
        ends = np.cumsum(size)
        who = np.arange(int(ends[-1])) + np.repeat(start - (ends - size), size)  # all members of the buckets left
        # the first member, then those that aren't in its component and weren't compared yet: one by one, later many at once
        waits = ~asked[who] & (root[who] != np.repeat(root[start], size))
        waits[ends - size] = ~asked[start]
        many = np.cumsum(waits)
        first = np.r_[0, many[ends[:-1] - 1]]
        waits &= many - np.repeat(first, size) <= (1 if rounds < SINGLY else TOGETHER)
        refs, of = who[waits], np.repeat(np.arange(len(start)), size)[waits]
        asked[refs] = True
        pairs = np.cumsum(size[of])
        for lo in range(0, int(pairs[-1]) if len(refs) else 0, PAIRS):
            take = slice(*np.searchsorted(pairs, [lo, lo + PAIRS], "right"))
            x, n_each = np.repeat(refs[take], size[of[take]]), size[of[take]]
            y = np.arange(len(x)) - np.repeat(np.cumsum(n_each) - n_each, n_each) + np.repeat(start[of[take]], n_each)
            x, y = (z[root[y] != root[x]] for z in (x, y))
            for d in far:
                near = np.abs(d[x] - d[y]) <= BITS
                before = len(x)
                x, y = x[near], y[near]
                if 8 * len(x) >= 7 * before:  # what is left is near mostly: verifying it is cheaper
                    break
            near = np.bitwise_count(fp[x] ^ fp[y]) <= BITS
            x, y = x[near], y[near]
            if len(x):
                a.append(x)
                b.append(y)
                nodes, at = np.unique(np.r_[root[x], root[y]], return_inverse=True)
                top = nodes[local_components(len(nodes), at[: len(x)], at[len(x) :])]
                i = np.minimum(np.searchsorted(nodes, root[who]), len(nodes) - 1)
                root[who] = np.where(nodes[i] == root[who], top[i], root[who])
        on = np.bincount(of, minlength=len(start)) > 0
        start, size = start[on], size[on]
        rounds += 1
    z = np.zeros(0, np.int64)
    return np.concatenate([z, *a]), np.concatenate([z, *b])


def _link(masks: list[np.uint64], forest: bool):
    """Of the buckets of one partition a spanning forest of the links, or pairs that are linked themselves."""

    @released
    def run(batches):
        got = [unpack(x.as_py()) for b in batches for x in b.column(2)]
        if not got:
            return
        table, fp = (np.concatenate(x) for x in zip(*got, strict=True))
        key = fp & np.array(masks)[table]
        order = np.lexsort((fp, key, table))
        table, fp, key = table[order], fp[order], key[order]
        bucket = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (table[1:] != table[:-1])])
        a, b = bucket_links(bucket, fp)
        nodes, at = np.unique(fp, return_inverse=True)
        if forest:
            root = local_components(len(nodes), at[a], at[b])
            tied = np.flatnonzero(root != np.arange(len(nodes)))
            u, v = nodes[tied], nodes[root[tied]]
        else:
            pairs = np.unique(np.stack([np.minimum(fp[a], fp[b]), np.maximum(fp[a], fp[b])], 1), axis=0)
            u, v = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return run


def near_fingerprints(fps: DataFrame, rows: int, parts: int, forest: bool = True) -> DataFrame:
    """(u, v) of distinct fingerprints (fp), of which there are at most so many rows: links that hold together what
    at most BITS differing bits connect; with forest=False each differs in so few itself."""
    masks = tables(rows)
    return to_part(parts, fps.select("fp").mapInArrow(_to_buckets(masks, parts), PARTS_SQL), "part").mapInArrow(_link(masks, forest), "u long, v long")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Rows (doc_id, code of the text, fp), of each fingerprint (fp, least, n) the row that has the least id and then the
    least code, and how many have it, (fp, root) of those that are linked, and the number of rows."""
    rows = pick(docs, k=(id_col, "long"), t=(text_col, "string")).select("k", "t", F.xxhash64("t").alias("code"))
    n = partitions(rows, 64 << 20)
    marked = checkpoint(rows.mapInArrow(_fingerprint, "doc_id long, code long, fp long"))
    least = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "code")).alias("least"), F.count("*").alias("n"))
    count = marked.count()
    links = near_fingerprints(least, count, n)
    return marked, least, components(links).withColumnRenamed("node", "fp"), count


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id): fingerprints of 4-word shingles, linked at 4 or fewer differing bits."""
    marked, least, tied, rows = _grouped(docs, id_col, text_col)
    linked = least.join(tied, "fp").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    # a component's name goes to as many places as a large component's members are dealt to
    named = linked.groupBy("root").agg(F.min("least").alias("first")).select("root", F.col("first.doc_id").alias("name"), F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    of = least.join(linked.join(named, ["root", "salt"]).select("fp", "name", F.lit(True).alias("tied")), "fp", "left")
    # a fingerprint of very many rows, such as exact copies', meets its name in as many places; fewer than HOT_SHARE have so many
    hot = F.broadcast(least.where(F.col("n") > max(HOT_LEAST, rows // HOT_SHARE)).select("fp", F.lit(True).alias("hot")))
    places = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    sent = of.join(hot, "fp", "left").select("fp", F.when(F.col("tied"), F.col("name")).otherwise(F.col("least.doc_id")).alias("component_id"), F.explode(places).alias("place"))
    placed = marked.join(hot, "fp", "left").withColumn("place", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "code"), F.lit(SALTS)).cast("int")).otherwise(0))
    return placed.join(sent, ["fp", "place"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, of one document of each component: that of the smallest id.
    Of rows that repeat its id and text one stays."""
    marked, least, tied, _ = _grouped(docs, id_col, text_col)
    of = least.join(tied, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "least")
    first = of.groupBy("root").agg(F.min("least").alias("first")).select(F.col("first.doc_id").alias("k"), F.col("first.code").alias("code"))
    plain, names = flat(docs)
    rows = plain.withColumns({"__k": F.col(f"__c{position(names, id_col)}").cast("long"), "__code": F.xxhash64(F.col(f"__c{position(names, text_col)}").cast("string"))})
    kept = rows.join(first.hint("shuffle_hash"), rows["__k"].eqNullSafe(first["k"]) & (rows["__code"] == first["code"]), "left_semi")
    # repeated rows are looked for by their keys alone, so that texts move again only where there are some
    if marked.groupBy("doc_id", "code").count().where("count > 1").isEmpty():
        return kept.drop("__k", "__code").toDF(*names)
    return kept.dropDuplicates(["__k", "__code"]).drop("__k", "__code").toDF(*names)
