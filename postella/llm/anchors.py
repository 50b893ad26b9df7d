"""Anchored windows: which windows of L tokens also occur earlier, exactly, with one compact shuffle.

Every window of L tokens has one *anchor*: the k-gram in it whose hash is least (winnowing). As
that depends on the window's content alone, equal windows have equal anchors at equal offsets.
Consecutive windows with the same anchor make a *run*. A map task sends each run's content
once, to the partition of its anchor; whatever a task can decide itself (a run that it has
already met earlier) is never sent, so a passage with millions of copies costs one row a task.
In its partition a run that equals an earlier run is repeated as a whole; only runs that share an
anchor and differ are opened, window by window, by the resolver of the operator. A partition with more than usual is opened
in passes over parts of its anchors; its packed rows are held meanwhile, so partitions are made of a fixed part of the input.

Anchors that very many different runs share, as at the end of boilerplate, are found in a sample of documents. Their
windows don't meet at the anchor: each is sent as a hash of its own content to that hash's partition, those that the task
has met earlier excepted. Which anchors these are changes where windows meet, never the result.

The cost is linear in the text: about (L + w/2) / (w/2) times its tokens are sent, w = L - k + 1,
less the copies, zstd-compressed; each text is shuffled once more to meet its ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import NULL_ID, Chunk, chunks, ids_of, in_part, mix, pack, partitions, pick, pick_with_rest, released, to_part, unpack

PARTS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
PARTS_SQL = "part int, kind int, blob binary"
RUNS, RANGES, TEXTS, HASHES = 0, 1, 2, 3
#: Tokens handled at once by the numpy passes.
STEP = 1 << 20
#: Windows of a resolver's slice.
WINDOWS = 1 << 20
#: Bytes of run content that a task gathers before it sends.
FLUSH = 28 << 20
#: Bytes of input for a partition, and bytes of packed runs that are opened in one pass.
PARTITION, OPENED = 6 << 20, 24 << 20
#: One document of so many is sampled for hot anchors; an anchor is hot with so many sampled runs; so many are told apart.
SAMPLE, HOT, TOLD = 64, 400, 100_000
#: Places of the filter of repeated ids.
SLOTS = 1 << 20
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93


@dataclass(frozen=True)
class Spec:
    """length: tokens of a window; k: tokens of an anchor; words: tokens are words, else bytes;
    across: only windows of smaller ids count as earlier, else also earlier ones of the same document."""

    length: int
    k: int
    words: bool
    across: bool


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i : i + k] for each i, by doubling."""
    powers, done, out = h, 1, None
    have = 0
    n = len(h) - k + 1
    rest = k
    while rest:
        if rest & 1:
            part = powers[have : have + n]
            out = part if out is None else out * np.uint64(pow(_BASE, done, 1 << 64)) + part
            have += done
        rest >>= 1
        if rest:
            powers = powers[: len(powers) - done] * np.uint64(pow(_BASE, done, 1 << 64)) + powers[done:]
            done *= 2
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    done = 1
    while done * 2 <= w:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (w - done)], x[w - done :]) if w > done else x


def runs_of(h: np.ndarray, offs: np.ndarray, spec: Spec) -> tuple[np.ndarray, ...]:
    """Runs of the token hashes h with document bounds offs: document, first window, windows, anchor's position."""
    out = []
    w = spec.length - spec.k + 1
    low = np.uint64(STEP * 2 - 1)
    for base in range(0, max(len(h) - spec.length + 1, 0), STEP):
        part = h[base : base + STEP + spec.length - 1]
        m = len(part) - spec.length + 1
        key = mix(grams(part, spec.k))
        key &= ~low
        key |= np.arange(len(key), dtype=np.uint64)
        at = (sliding_min(key, w) & low).astype(np.int32)
        clipped = np.clip(offs - base, 0, m)
        doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(clipped))
        valid = np.arange(m) + (base + spec.length) <= offs[doc + 1]
        edge = np.empty(m, bool)
        edge[0] = True
        edge[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
        edge |= ~valid
        cuts = np.flatnonzero(edge)
        nxt = np.r_[cuts[1:], m]
        ok = valid[cuts]
        first = cuts[ok]
        out.append((doc[first], first + base, (nxt[ok] - first), at[first].astype(np.int64) + base))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))


def words_of(chunk: Chunk) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by one space, byte starts (end appended), word hashes, word offsets of documents."""
    every: list[bytes] = []
    counts = np.zeros(len(chunk) + 1, np.int64)
    for i, t in enumerate(chunk.texts()):
        w = t.split()
        counts[i + 1] = len(w)
        every += w
    n = len(every)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, every), np.int64, n) + 1, out=starts[1:])
    return b" ".join(every) + b" ", starts, np.fromiter(map(xxhash.xxh3_64_intdigest, every), np.uint64, n), np.cumsum(counts)


def _slot(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(SLOTS)).astype(np.int64)


def repeated_ids(rows: DataFrame) -> np.ndarray:
    """A filter of fixed size that ids of more than one row pass, and few others."""

    def slots(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(ids_of(b.column(0)))))], names=["slot"])

    twice = rows.groupBy("k").count().where("count > 1").select("k")
    out = np.zeros(SLOTS, bool)
    out[twice.mapInArrow(slots, "slot long").distinct().toArrow().column(0).to_numpy()] = True
    return out


def tags_of(chunk: Chunk, repeated: np.ndarray) -> np.ndarray:
    """What tells apart different texts under one id: a text's 64-bit hash where the filter of repeated ids says so, else 0,
    which takes no room."""
    out = np.zeros(len(chunk), np.uint64)
    raw, o = chunk.data.tobytes(), chunk.offs
    for i in np.flatnonzero(repeated[_slot(chunk.ids)]):
        out[i] = xxhash.xxh3_64_intdigest(raw[o[i] : o[i + 1]])
    return out


def later(doc, pos, first_doc, first_pos, across: bool) -> np.ndarray:
    return doc > first_doc if across else (doc > first_doc) | ((doc == first_doc) & (pos > first_pos))


def firsts(key: np.ndarray) -> np.ndarray:
    """For each element the index of the first equal one."""
    _, index, inverse = np.unique(key, return_index=True, return_inverse=True)
    return index[inverse]


def merged(doc, tag, start, n) -> tuple[np.ndarray, ...]:
    """Sorted ranges of window starts, neighbours joined."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], (start + n)[order]
    if len(doc):
        new = np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > end[:-1])]
        at = np.flatnonzero(new)
        doc, tag, start, end = doc[at], tag[at], start[at], np.maximum.reduceat(end, at)
    return doc, tag, start, end


def rows_of(part: np.ndarray, kind: int, make: Callable[[np.ndarray], tuple]) -> Iterator[pa.RecordBatch]:
    """One packed row for each part; make gets the indices of the part's elements."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    s = part[order]
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    got: list[tuple[int, bytes]] = []
    size = 0
    for i, j in zip(at, np.r_[at[1:], len(s)], strict=True):
        got.append((int(s[i]), pack(make(order[i:j]))))
        size += len(got[-1][1])
        if size > 8 << 20:
            yield _batch(got, kind)
            got, size = [], 0
    if got:
        yield _batch(got, kind)


def _batch(got: list[tuple[int, bytes]], kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int32()), pa.array([kind] * len(got), pa.int32()), pa.array([b for _, b in got], pa.binary())], schema=PARTS)


def range_rows(doc, tag, start, n, parts: int) -> Iterator[pa.RecordBatch]:
    doc, tag, start, end = merged(doc, tag, start, n)
    yield from rows_of(in_part(doc, parts), RANGES, lambda i: (doc[i], tag[i], start[i].astype(np.int64), end[i].astype(np.int64)))


def _planes(x: np.ndarray) -> list[bytes]:
    """The bytes of small integers, lowest first; planes of zeros at the end are left out, and the others compress well."""
    x = x.astype("<u8").view(np.uint8).reshape(-1, 8)
    used = np.flatnonzero(x.any(axis=0))
    return [x[:, j].tobytes() for j in range(int(used[-1]) + 1 if len(used) else 1)]


def _joined(planes: list[bytes]) -> np.ndarray:
    out = np.zeros(len(planes[0]), np.int64)
    for j, p in enumerate(planes):
        out |= np.frombuffer(p, np.uint8).astype(np.int64) << (8 * j)
    return out


def _packed(doc, tag, first, n, off, size, content: bytes, spec: Spec) -> tuple:
    """Runs in the order of (document, position), each document once; a run of bytes has its size from its windows."""
    new = np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]
    at = np.flatnonzero(new)
    return doc[at], tag[at], _planes(new[1:]), _planes(first), _planes(n), _planes(off), _planes(size) if spec.words else None, content


def _unpacked(got: tuple, spec: Spec) -> tuple:
    doc, tag, new, first, n, off, size, content = got
    first = _joined(first)
    i = np.zeros(len(first), np.int64)
    if len(first) > 1:
        np.cumsum(_joined(new), out=i[1:])
    n = _joined(n)
    return doc[i], tag[i], first, n, _joined(off), _joined(size) if spec.words else n + spec.length - 1, content


def _runs_in(chunk: Chunk, spec: Spec) -> tuple | None:
    """The chunk's runs: document, first window, windows, bounds of content and of anchor in the buffer; and buffer, offsets."""
    if spec.words:
        buf, starts, h, offs = words_of(chunk)
    else:
        buf, h, offs = chunk.data.tobytes(), _BYTE[chunk.data], chunk.offs
    d, first, n, at = runs_of(h, offs, spec)
    if not len(d):
        return None
    last = first + n + spec.length - 1
    if spec.words:
        return d, first, n, starts[first], starts[last] - 1, starts[at], starts[at + spec.k] - 1, buf, offs
    return d, first, n, first, last, at, at + spec.k, buf, offs


def anchor_counter(spec: Spec):
    """(anchor, n): the runs of each anchor in the documents."""

    @released
    def run(batches):
        for chunk in chunks(batches, 3 << 20):
            if got := _runs_in(chunk, spec):
                *_, alo, ahi, buf, _ = got
                anchor, n = np.unique(_hashes(buf, alo, ahi), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n, pa.int64())], names=["anchor", "n"])

    return run


def hot_anchors(rows: DataFrame, spec: Spec) -> np.ndarray:
    """Anchors of very many runs in a sample, at most TOLD, sorted."""
    found = rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(SAMPLE)) == 0).mapInArrow(anchor_counter(spec), "anchor long, n long")
    hot = found.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "anchor").limit(TOLD).toArrow()
    return np.sort(hot.column(0).to_numpy().view(np.uint64))


def window_hashes(content: list[bytes], n: np.ndarray, spec: Spec) -> np.ndarray:
    """A hash of each window of runs with this content and so many windows."""
    if spec.words:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, b" ".join(content).split(b" ")), np.uint64)
    else:
        h = _BYTE[np.frombuffer(b"".join(content), np.uint8)]
    size = n + spec.length - 1
    before = np.cumsum(n) - n
    start = np.repeat(np.cumsum(size) - size - before, n) + np.arange(int(n.sum()))
    return mix(grams(h, spec.length)[start])


def _repeated(key, doc, pos, across: bool) -> np.ndarray:
    """Whether each window has an earlier equal one."""
    order = np.lexsort((pos, doc))
    f = np.empty(len(doc), np.int64)
    f[order] = order[firsts(key[order])]
    return later(doc, pos, doc[f], pos[f], across)


def run_mapper(spec: Spec, parts: int, hot, repeated):
    """From documents (id, text): their runs, less those that the task has met earlier; of those the ranges."""

    def send(gathered: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, tag, first, n, off, size, code, anchor = (np.concatenate(x) for x in list(zip(*gathered, strict=True))[:8])
        content = [c for g in gathered for c in g[8]]
        order = np.lexsort((first, doc))
        f = np.empty(len(doc), np.int64)
        f[order] = order[firsts(code[order])]
        gone = later(doc, first, doc[f], first[f], spec.across)
        yield from range_rows(doc[gone], tag[gone], first[gone], n[gone], parts)
        rest = order[~gone[order]]
        if len(hot.value):
            many = np.isin(anchor[rest], hot.value)
            mine = rest[many]
            steps = np.searchsorted(np.cumsum(n[mine]), np.arange(WINDOWS, int(n[mine].sum()), WINDOWS))
            for some in np.split(mine, steps):
                yield from send_windows(*(x[some] for x in (doc, tag, first, n)), [content[j] for j in some])
            rest = rest[~many]
        yield from rows_of((mix(anchor[rest]) % np.uint64(parts)).astype(np.int64), RUNS, lambda i: _packed(doc[rest[i]], tag[rest[i]], first[rest[i]], n[rest[i]], off[rest[i]], size[rest[i]], b"".join([content[j] for j in rest[i]]), spec))

    def send_windows(doc, tag, first, n, content) -> Iterator[pa.RecordBatch]:
        if not len(doc):
            return
        key = window_hashes(content, n, spec)
        pos = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(key))
        doc, tag = np.repeat(doc, n), np.repeat(tag, n)
        gone = _repeated(key, doc, pos, spec.across)
        yield from range_rows(doc[gone], tag[gone], pos[gone], np.ones(int(gone.sum()), np.int64), parts)
        i = np.flatnonzero(~gone)
        yield from rows_of((key[i] % np.uint64(parts)).astype(np.int64), HASHES, lambda j: (key[i[j]], doc[i[j]], tag[i[j]], pos[i[j]]))

    @released
    def run(batches):
        gathered, held = [], 0
        for chunk in chunks(batches, 3 << 20):
            tags = tags_of(chunk, repeated.value)
            if not (got := _runs_in(chunk, spec)):
                continue
            d, first, n, lo, hi, alo, ahi, buf, offs = got
            content = [buf[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
            code = np.fromiter(map(xxhash.xxh3_64_intdigest, content), np.uint64, len(content))
            gathered.append((chunk.ids[d], tags[d], first - offs[d], n, alo - lo, hi - lo, code, _hashes(buf, alo, ahi), content))
            held += int((hi - lo).sum()) + 120 * len(content)
            if held > FLUSH:
                yield from send(gathered)
                gathered, held = [], 0
        if gathered:
            yield from send(gathered)

    return run


class Runs:
    """The runs of one partition, or those that the masks, one for each blob, choose."""

    def __init__(self, blobs: list[bytes], spec: Spec, masks: list[np.ndarray] | None = None):
        got, contents = [], []
        for k, b in enumerate(blobs):
            *numbers, content = _unpacked(unpack(b), spec)
            if masks:
                i = np.flatnonzero(masks[k])
                ends = np.r_[0, np.cumsum(numbers[5])]
                content = b"".join([content[x:y] for x, y in zip(ends[i].tolist(), ends[i + 1].tolist(), strict=True)])
                numbers = [x[i] for x in numbers]
            got.append(numbers)
            contents.append(content)
        self.buf = b"".join(contents)
        contents.clear()
        self.doc, self.tag, self.first, self.n, self.off, size = (np.concatenate([g[i] for g in got]) for i in range(6))
        self.lo = np.r_[0, np.cumsum(size)]

    def content(self, i) -> Iterator[bytes]:
        buf = self.buf
        return (buf[a:b] for a, b in zip(self.lo[i].tolist(), self.lo[i + 1].tolist(), strict=True))


def resolver(spec: Spec, parts: int, windows: Callable[[Runs, np.ndarray], np.ndarray]):
    """Ranges of the repeated windows of a partition. windows gets runs that share anchors and differ,
    ordered by (document, position), and says of each of their windows whether it is repeated."""

    @released
    def run(batches):
        blobs: list[bytes] = []
        hashed: list[tuple] = []
        for b in batches:
            kinds = b.column(1).to_numpy()
            if (kinds == RANGES).any():
                yield b.filter(pa.array(kinds == RANGES))
            blobs += [b.column(2)[int(i)].as_py() for i in np.flatnonzero(kinds == RUNS)]
            hashed += [unpack(b.column(2)[int(i)].as_py()) for i in np.flatnonzero(kinds == HASHES)]
        if hashed:
            key, doc, tag, pos = (np.concatenate(x) for x in zip(*hashed, strict=True))
            gone = _repeated(key, doc, pos, spec.across)
            yield from range_rows(doc[gone], tag[gone], pos[gone], np.ones(int(gone.sum()), np.int64), parts)
            del hashed, key, doc, tag, pos, gone
        passes = min(64, sum(map(len, blobs)) // OPENED + 1)
        if passes == 1 and blobs:
            every = Runs(blobs, spec)
            blobs.clear()
            yield from resolve(every)
        elif blobs:
            nth = []
            for b in blobs:
                r = Runs([b], spec)
                lo = r.lo[:-1] + r.off
                nth.append((mix(_hashes(r.buf, lo, lo + _anchor_size(r, spec))) >> np.uint64(32)) % np.uint64(passes))
            for i in range(passes):
                yield from resolve(Runs(blobs, spec, [x == i for x in nth]))

    def resolve(r: Runs) -> Iterator[pa.RecordBatch]:
        if not len(r.doc):
            return
        order = np.lexsort((r.first, r.doc))
        code = np.fromiter((xxhash.xxh3_64_intdigest(c) for c in r.content(order)), np.uint64, len(order))
        doc, first = r.doc[order], r.first[order]
        f = firsts(code)
        gone = later(doc, first, doc[f], first[f], spec.across)
        g = order[gone]
        yield from range_rows(r.doc[g], r.tag[g], r.first[g], r.n[g], parts)
        open_ = _differing(r, order, ~gone, f == np.arange(len(f)), spec)
        found = []
        for slice_ in open_:  # of whole groups of anchors
            i = order[slice_]
            bad = windows(r, i)
            n = r.n[i]
            at = np.flatnonzero(bad)
            which = i[np.repeat(np.arange(len(i)), n)[at]]
            nth = (np.arange(len(bad)) - np.repeat(np.cumsum(n) - n, n))[at]
            found.append((r.doc[which], r.tag[which], r.first[which] + nth, np.ones(len(at), np.int64)))
        if found:
            yield from range_rows(*map(np.concatenate, zip(*found, strict=True)), parts)

    return run


def _hashes(buf: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(buf[i:j]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)), np.uint64, len(lo))


def _shared(key: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Whether runs of different content have the key; rep marks one run of each content."""
    values, counts = np.unique(key[rep], return_counts=True)
    return np.isin(key, values[counts > 1])


def _differing(r: Runs, order: np.ndarray, alive: np.ndarray, rep: np.ndarray, spec: Spec) -> Iterator[np.ndarray]:
    """Positions in order of the runs to open: they share an anchor with a run of other content, and, where tokens are
    bytes, one of its halves: a window reaches at least half of what it has beside its anchor to one
    side, so runs that differ on both sides within that share no window. In slices of about WINDOWS windows."""
    size = _anchor_size(r, spec)[order]
    lo = r.lo[order] + r.off[order]
    hi = lo + size
    anchor = _hashes(r.buf, lo, hi)
    at = np.flatnonzero(_shared(anchor, rep))
    if not spec.words and len(at):
        half = (spec.length - spec.k + 1) // 2
        part = np.zeros(len(at), bool)
        left = np.flatnonzero(lo[at] - half >= r.lo[order[at]])
        part[left] |= _shared(_hashes(r.buf, lo[at[left]] - half, hi[at[left]]), rep[at[left]])
        right = np.flatnonzero(hi[at] + half <= r.lo[order[at] + 1])
        part[right] |= _shared(_hashes(r.buf, lo[at[right]], hi[at[right]] + half), rep[at[right]])
        at = at[part]
    at = at[alive[at]]
    slices = int(r.n[order[at]].sum()) // WINDOWS + 1
    which = mix(anchor[at]) % np.uint64(slices)
    for s in range(slices):
        mine = at[which == s]
        if len(mine):
            yield mine


def _anchor_size(r: Runs, spec: Spec) -> np.ndarray:
    """Bytes of each run's anchor."""
    if not spec.words:
        return np.full(len(r.doc), spec.k, np.int64)
    space = np.flatnonzero(np.frombuffer(r.buf + b" ", np.uint8) == 32)
    lo, off, end = r.lo[:-1], r.off, r.lo[1:]
    # the anchor ends before the k-th space after its start, or where the run ends
    j = np.searchsorted(space, lo + off) + spec.k - 1
    stop = np.minimum(space[np.minimum(j, len(space) - 1)], end)
    return stop - (lo + off)


def text_mapper(parts: int, repeated):
    """Packs whole texts for their partition."""

    @released
    def run(batches):
        for chunk in chunks(batches, 8 << 20):
            tags, texts = tags_of(chunk, repeated.value), chunk.texts()
            rest = chunk.batch.slice(chunk.lo, len(chunk)).select(range(2, chunk.batch.num_columns))
            yield from rows_of(in_part(chunk.ids, parts), TEXTS, lambda i: (chunk.ids[i], tags[i], chunk.null[i], [texts[j] for j in i], rest.take(pa.array(i)) if rest.num_columns else None))  # noqa: B023

    return run


def with_ranges(names: list[str], make: Callable[[np.ndarray, np.ndarray, list[bytes], list[np.ndarray]], list[pa.Array]]):
    """Texts meet their ranges. make gets ids, null flags, texts and for each an (m, 2) array of window ranges;
    its arrays are followed by the columns that came along."""

    @released
    def run(batches):
        texts, found = [], []
        for b in batches:
            for kind, blob in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                if kind == TEXTS:
                    texts.append(blob.as_py())
                else:
                    found.append(unpack(blob.as_py()))
        if found:
            doc, tag, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        else:
            doc, tag, start, end = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc, tag, start, end = merged(doc, tag, start, end - start)
        spans = np.stack([start, end], 1) if len(start) else np.zeros((0, 2), np.int64)
        for blob in texts:
            ids, tags, null, data, rest = unpack(blob)
            size = 0
            lo = 0
            left, right = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
            mine = [spans[a:b][tag[a:b] == t] for a, b, t in zip(left, right, tags, strict=True)]
            for i in range(len(ids)):
                size += len(data[i])
                if size > 4 << 20 or i == len(ids) - 1:
                    part = slice(lo, i + 1)
                    more = rest.slice(lo, i + 1 - lo).columns if rest else []
                    yield pa.RecordBatch.from_arrays([*make(ids[part], null[part], data[part], mine[part]), *more], names=names)
                    lo, size = i + 1, 0

    return run


def run_rows(rows: DataFrame, spec: Spec, parts: int, hot: np.ndarray, repeated: np.ndarray) -> DataFrame:
    """The packed runs of documents (k, t), and the ranges that their tasks know of."""
    send = rows.sparkSession.sparkContext.broadcast
    return rows.mapInArrow(run_mapper(spec, parts, send(hot), send(repeated)), PARTS_SQL)


def resolved(runs: DataFrame, whole: DataFrame, spec: Spec, windows, schema_sql: str, make, parts: int, repeated: np.ndarray) -> DataFrame:
    """Runs meet at their anchors' partitions, ranges and texts (k, t, more) at their documents' partitions."""
    out = StructType.fromDDL(schema_sql)
    for f in whole.schema.fields[2:]:
        out.add(f.name, f.dataType)
    ranges = to_part(parts, runs, "part").mapInArrow(resolver(spec, parts, windows), PARTS_SQL)
    texts = whole.mapInArrow(text_mapper(parts, whole.sparkSession.sparkContext.broadcast(repeated)), PARTS_SQL)
    return to_part(parts, ranges.union(texts), "part").mapInArrow(with_ranges(out.names, make), out)


def deduplicate(docs: DataFrame, id_col: str, text_col: str, spec: Spec, windows, schema_sql: str, make, carry: bool = False) -> DataFrame:
    """The three steps: runs to their anchors' partitions, ranges and texts to their documents' partitions, results.
    carry: all columns of docs come along, named by position."""
    want = {"k": (id_col, "long"), "t": (text_col, "string")}
    rows = pick(docs, **want)
    whole = pick_with_rest(docs, **want)[0] if carry else rows
    n, repeated = partitions(rows, PARTITION), repeated_ids(rows)
    return resolved(run_rows(rows, spec, n, hot_anchors(rows, spec), repeated), whole, spec, windows, schema_sql, make, n, repeated)


def anonymous(spec: Spec):
    """Packed runs and window hashes as those of one document before all others, each content of a task once."""

    @released
    def run(batches):
        for b in batches:
            for part, kind, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == RUNS:
                    r = Runs([blob], spec)
                    yield _batch([(part, _nameless(r, np.arange(len(r.doc)), spec))], RUNS)
                elif kind == HASHES:
                    key = np.unique(unpack(blob)[0])
                    yield _batch([(part, pack((key, np.full(len(key), NULL_ID), np.zeros(len(key), np.uint64), np.arange(len(key)))))], HASHES)

    return run


def _nameless(r: Runs, i: np.ndarray, spec: Spec) -> bytes:
    """Some of the runs packed as one document's, each content once."""
    content = list(r.content(i))
    code = np.fromiter(map(xxhash.xxh3_64_intdigest, content), np.uint64, len(content))
    _, one = np.unique(code, return_index=True)
    at = i[one]
    # windows of a run stand one after the other; runs are set apart so that none seems to go on from another
    first = np.cumsum(r.n[at] + spec.length) - r.n[at] - spec.length
    return pack(_packed(np.full(len(at), NULL_ID), np.zeros(len(at), np.uint64), first, r.n[at], r.off[at], (r.lo[1:] - r.lo[:-1])[at], b"".join([content[j] for j in one]), spec))


def merged_levels(spec: Spec):
    """Nameless runs and hashes of a partition put together, in as many rows as are opened at once."""

    @released
    def run(batches):
        held: dict[tuple[int, int], list[bytes]] = {}
        for b in batches:
            for part, kind, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                held.setdefault((part, kind), []).append(blob)
        for (part, kind), blobs in sorted(held.items()):
            passes = sum(map(len, blobs)) // OPENED + 1
            for p in range(passes):
                if kind == HASHES:
                    key = np.unique(np.concatenate([k[k % np.uint64(passes) == p] for k in (unpack(x)[0] for x in blobs)]))
                    yield _batch([(part, pack((key, np.full(len(key), NULL_ID), np.zeros(len(key), np.uint64), np.arange(len(key)))))], HASHES)
                    continue
                masks = []
                for x in blobs:
                    r = Runs([x], spec)
                    masks.append(np.fromiter((xxhash.xxh3_64_intdigest(c) % passes == p for c in r.content(np.arange(len(r.doc)))), bool, len(r.doc)))
                r = Runs(blobs, spec, masks)
                if len(r.doc):
                    yield _batch([(part, _nameless(r, np.arange(len(r.doc)), spec))], RUNS)

    return run
