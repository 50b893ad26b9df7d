"""Substring deduplication by seed and extend.

Seeds are winnowed anchors of a few words; documents meet on equal anchors (``anchors.py``). Around a
shared seed the occurrences are extended both ways, to every split of the threshold between words
before and after it; equal extensions are found by their hash, so a group of m occurrences is
sorted rather than compared in pairs. Neighbouring repeated windows join to maximal repeats.

Rows: one per document row. A null or empty text has no words; a null id sorts before all others. Rows that
repeat an id and its text get the same result, as neither is earlier. Of ties, equal windows, the one that starts first in
the order of ids stays. Very long texts are read whole. An empty table gives no rows. Columns are taken by name, the
first of those that clash; others don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .anchors import Runs, Spec, deduplicate, firsts, grams, later
from .common import id_array

SQL = "doc_id long, n_words long, n_removed long, spans array<struct<first: long, end: long>>, kept string"


def _windows(spec: Spec):
    def decide(r: Runs, i: np.ndarray) -> np.ndarray:
        every = b" ".join(r.content(i)).split(b" ")
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, every), np.uint64, len(every))
        n = r.n[i]
        size = n + spec.length - 1
        first = np.cumsum(size) - size
        start = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        key = grams(h, spec.length)[start]
        doc = np.repeat(r.doc[i], n)
        pos = np.repeat(r.first[i], n) + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((pos, doc))
        f = np.empty(len(doc), np.int64)
        f[order] = order[firsts(key[order])]
        return later(doc, pos, doc[f], pos[f], spec.across)

    return decide


def spans_array(spans: list[np.ndarray], length: int, first: str = "first") -> tuple[pa.Array, list[list[tuple[int, int]]]]:
    """Window ranges to maximal token spans, as an Arrow list of structs and as lists."""
    out = []
    for s in spans:
        mine: list[tuple[int, int]] = []
        for a, b in s.tolist():
            b += length - 1
            if mine and a <= mine[-1][1]:
                mine[-1] = (mine[-1][0], max(b, mine[-1][1]))
            else:
                mine.append((a, b))
        out.append(mine)
    flat = [x for m in out for x in m]
    struct = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.int64()), pa.array([b for _, b in flat], pa.int64())], names=[first, "end"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(m) for m in out])], pa.int32()), struct), out


def _make(length: int):
    def make(ids, null, texts, spans):
        array, lists = spans_array(spans, length)
        total, removed, kept = [], [], []
        for t, mine in zip(texts, lists, strict=True):
            w = t.split()
            total.append(len(w))
            removed.append(sum(b - a for a, b in mine))
            for a, b in reversed(mine):
                del w[a:b]
            kept.append(b" ".join(w).decode())
        return [id_array(ids), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), array, pa.array(kept, pa.string())]

    return make


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, k: int = 6) -> DataFrame:
    """Per document its words, the spans of words covered by windows of `length` words that also start
    earlier (in a smaller id, or before in the same document), and the words that stay, space-joined."""
    if not 1 <= k <= length:
        raise ValueError("k must be from 1 to length")
    spec = Spec(length, k, words=True, across=False)
    return deduplicate(docs, id_col, text_col, spec, _windows(spec), SQL, _make(length))
