"""Context-triggered piecewise hashing: fingerprints that stay alike where texts do.

A hash rolls over seven bytes; where it meets a condition a chunk ends, so that chunks after an edit are cut as before. The
condition of a block size b = 2 * 2^k holds for one position in b, and implies that of b / 2. A text's block size is the
least that cuts it into at most MOST chunks; its fingerprint has two signs for each chunk at b, 2b and 4b, so texts
whose own sizes differ by up to four times can be compared: by the edit distance of the signatures at the least size that both have.
A chunk's signs are from the sum of the rolling hashes at its bytes, so chunks of all sizes come from one running sum.

For the next document's text no window runs over all documents: ids are cut at quantiles, documents are dealt by the
cuts and sorted where they are, and the first document of each part is sent to the part before as well. What the driver sees is
the cuts and first ids, at most PARTS of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import _BYTE, grams
from .common import NULL_ID, id_array, ids_of, mix, partitions, pick, released, to_part

#: Bytes of the rolling window; least block size; chunks at most at a text's own block size; sizes with a signature.
WINDOW, LEAST, MOST, SIZES = 7, 2, 128, 3
#: Parts at most; a part is streamed, so it can be of any size. Bytes of input for one.
PARTS, PART_BYTES = 1 << 14, 16 << 20
#: Bytes of text that are hashed at once.
STEP = 1 << 20
#: Ends of chunks of one text that are held at once.
HELD = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
# The 64 signs of RFC 4648, of which a chunk gets two.
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PAIRS = np.array([a + b for a in SIGNS for b in SIGNS], "S2")
_ENDS = "part int, ahead int, k long, t string"
OUT = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def boundaries(data: bytes, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Ends of possible chunks, for each the greatest k for which it is one at block size LEAST * 2^k, the running sum there, and the
    sum of all; those of k below `least` are left out. Of long texts only the ends that can still count are held."""
    at, level, sums = [], [], []
    total, held = 0, 0
    for base in range(0, len(data), STEP):
        # seven bytes end at each position; before the text there are bytes of code 0
        part = np.frombuffer(data[max(0, base - WINDOW + 1) : base + STEP], np.uint8)
        codes = _BYTE[part]
        if base == 0:
            codes = np.concatenate([np.zeros(WINDOW - 1, np.uint64), codes])
        h = grams(codes, WINDOW) * _ODD
        i = np.flatnonzero(h < np.uint64(1 << (63 - least)))
        run = np.cumsum(h) + np.uint64(total)
        # 2^-k of all hashes have k zero bits on top; the exponent tells them
        at.append(i + base + 1)
        level.append(63 - np.frexp(h[i].astype(float))[1].astype(np.int64))
        sums.append(run[i])
        total, held = int(run[-1]), held + len(i)
        if held > HELD:
            at, level, sums = ([np.concatenate(x)] for x in (at, level, sums))
            least = max(least, _level(level[0], MOST))
            keep = level[0] >= least
            at, level, sums = ([x[0][keep]] for x in (at, level, sums))
            held = int(keep.sum())
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), 0
    return *(np.concatenate(x) for x in (at, level, sums)), total


def _level(level: np.ndarray, most: int) -> int:
    """The least k that fewer than `most` of the ends have, which with what follows the last makes at most `most` chunks."""
    return 0 if len(level) < most else int(np.partition(level, len(level) - most)[len(level) - most]) + 1


def fingerprint(data: bytes) -> str:
    """block size:signature:signature at twice the size:at four times. Equal texts have equal ones; of an empty text all are empty."""
    # a guess by the length leaves out ends that won't count; it was too high if too few are left
    at, level, sums, total = boundaries(data, max(0, (len(data) // MOST).bit_length() - 4))
    if len(level) < MOST:
        at, level, sums, total = boundaries(data)
    k = _level(level, MOST)
    ends = [np.zeros(1, np.uint64)]
    for i in range(SIZES):
        mine = np.flatnonzero(level >= k + i)
        # what follows the last end is a chunk too, and each signature begins at the text's start
        rest = [total] if data and (not len(mine) or at[mine[-1]] < len(data)) else []
        ends += [sums[mine], np.array([*rest, 0], np.uint64)]
    run = np.concatenate(ends)
    signs = _PAIRS[(mix(run[1:] - run[:-1]) & np.uint64(4095)).astype(np.int64)].tobytes().decode()
    out, lo = [str(LEAST << k)], 0
    for i in range(SIZES):
        n = len(ends[2 * i + 1]) + len(ends[2 * i + 2]) - 1
        out.append(signs[2 * lo : 2 * (lo + n)])
        lo += n + 1
    return ":".join(out)


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and replacements, a column of the table at a time as bits of one integer."""
    if not a or not b:
        return len(a) + len(b)
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, d = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        more = down | (~(diagonal | up) & full)
        less = diagonal & up
        d += bool(more & last) - bool(less & last)
        more, less = more << 1 | 1, less << 1
        up = (less | ~(diagonal | more)) & full
        down = more & diagonal & full
    return d


def likeness(a: str, b: str) -> float:
    """From 0 to 1: 1 less the edit distance over the longer signature, at the least block size that both have; 0 if there is none."""
    if a == b:
        return 1.0
    mine, its = ({int(size) << i: s for i, s in enumerate(signatures)} for size, *signatures in (a.split(":"), b.split(":")))
    if not (both := mine.keys() & its.keys()):
        return 0.0
    x, y = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (mine[min(both)], its[min(both)]))
    if not set(x) & set(y):
        return float(not x and not y)
    return 1 - edit_distance(x, y) / max(len(x), len(y))


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the beginning of the following one, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _cuts(ids: DataFrame, n: int) -> np.ndarray:
    """Ascending ids that part all ids into at most n parts of about the same number of rows."""
    if n < 2:
        return np.zeros(0, np.int64)
    shares = [i / n for i in range(1, n)]
    found = ids.agg(F.percentile_approx("k", shares, 100 * n)).first()[0] or []
    return np.unique(np.array(found, np.int64))


def _dealer(cuts: np.ndarray, firsts: np.ndarray, before: np.ndarray):
    """Rows to their part, and those of a part's first id to the part before it as well."""

    def run(batches):
        for b in batches:
            ids = ids_of(b.column(0))
            part = np.searchsorted(cuts, ids, "right").astype(np.int32)
            ahead = np.flatnonzero(np.isin(ids, firsts))
            for i, p, flag in ((None, part, 0), (ahead, before[np.searchsorted(firsts, ids[ahead])], 1)):
                if i is None or len(i):
                    rows = b if i is None else b.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(np.full(len(p), flag, np.int32)), id_array(ids if i is None else ids[i]), rows.column(1)], names=["part", "ahead", "k", "t"])

    return run


@released
def _fingerprints(batches):
    """Rows of parts in order: what is ahead of a part stands at its end. A row goes out when the next one is there."""
    last = None
    done: list[tuple] = []
    size = 0
    for b in batches:
        ahead = b.column(1).to_numpy()
        ids = ids_of(b.column(2))
        for i in range(b.num_rows):
            if ahead[i] and last is None:
                continue  # of rows ahead the first is enough
            text = b.column(3)[i].as_py() or ""
            mark = fingerprint(text.encode())
            if last is not None:
                k, before, its = last
                new = edited(before, text)
                its_new = fingerprint(new.encode())
                done.append((k, len(before), new, its, its_new, likeness(its, its_new), likeness(its, mark)))
                size += len(new)
                if size > STEP:
                    yield _rows(done)
                    done, size = [], 0
            last = None if ahead[i] else (int(ids[i]), text, mark)
    if done:
        yield _rows(done)


def _rows(done: list[tuple]) -> pa.RecordBatch:
    k, n, new, its, its_new, near_edited, near_next = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([id_array(np.array(k, np.int64)), pa.array(n, pa.int64()), pa.array(new, pa.string()), pa.array(its), pa.array(its_new), pa.array(near_edited, pa.float64()), pa.array(near_next, pa.float64())], names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def piecewise_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every row: its text's
    fingerprint, that of the text whose last half is replaced from the next row's beginning, and how like the first is
    to the second and to the next row's.

    Rows are in the order of ids, a null id first, rows of one id in the order of their texts, a null text first; the row after the last
    is the first, so a single row is its own next. Null and empty texts are alike and have the fingerprint of
    nothing. Texts are read whole, in steps. Rows of one id stand in one part, sorted outside memory if need be and streamed.
    An empty table gives no rows. Columns are taken by name, others don't matter."""
    rows = pick(docs, k=(id_col, "long"), t=(text_col, "string"))
    n = min(PARTS, partitions(rows, PART_BYTES))
    ids = rows.select(F.coalesce("k", F.lit(NULL_ID)).alias("k"))
    cuts = _cuts(ids, n)

    def parts_of(batches):
        for b in batches:
            k = ids_of(b.column(0))
            part = np.searchsorted(cuts, k, "right")
            least = np.full(len(cuts) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, part, k)
            has = np.unique(part)
            yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(least[has])], names=["part", "k"])

    heads = ids.mapInArrow(parts_of, "part int, k long").groupBy("part").agg(F.min("k").alias("k")).orderBy("part").toArrow()
    firsts, own = heads.column("k").to_numpy(), heads.column("part").to_numpy()
    dealt = to_part(len(cuts) + 1, rows.mapInArrow(_dealer(cuts, firsts, np.roll(own, 1)), _ENDS), "part")
    return dealt.sortWithinPartitions("part", "ahead", "k", "t").mapInArrow(_fingerprints, OUT)
