"""Suffix-array deduplication with a logarithmic index family.

An array of all suffixes takes many times the text's bytes, so suffixes are sampled: each one
starts at a window that lies around a winnowed anchor shared by different contexts (``anchors.py``);
every string of `length` bytes falls into exactly one of them, so nothing is lost. In each partition
of anchors, documents come in order of their ids, in batches. A batch gets its suffix array (suffix
prefixes of `length` bytes in byte order), is merge-scanned against the levels that exist, and then
becomes a level itself; levels of equal size merge, so that n suffixes make at most log2(n) levels
and each is moved log2(n) times.

The index isn't kept between calls: a family of levels lives as long as its partition's pass. Windows that are equal
as whole runs, and windows of anchors that very many runs share, are settled by hash before.

Rows: one per document row. A null text is empty; a null id sorts before all others. Rows that
repeat an id never match each other, as neither id is smaller. Of ties, equal strings, those of the smallest id stay.
Very long texts are read whole. An empty table gives no rows. Columns are taken by name, the first of those that clash;
`suffix_dedup` reads no others, `cut_repeats` returns all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Runs, Spec, deduplicate
from .common import flat, id_array, position
from .substring_dedup import spans_array

SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<first: long, end: long>>, kept binary"
#: Suffixes of a batch; levels hold about this many times a power of two.
BATCH = 1 << 16


class SuffixLevels:
    """Sorted arrays of suffix prefixes with the smallest document of each; sizes grow geometrically."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The smallest document known for each of the sorted keys, at most docs."""
        out = docs.copy()
        for have, first in self.levels:
            at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            hit = have[at] == keys
            out[hit] = np.minimum(out[hit], first[at[hit]])
        return out

    def append(self, keys: np.ndarray, docs: np.ndarray) -> None:
        """A new level of sorted distinct keys; equal-sized levels merge."""
        self.levels.append((keys, docs))
        while len(self.levels) > 1 and self._rank(-2) <= self._rank(-1):
            (k2, d2), (k1, d1) = self.levels.pop(), self.levels.pop()
            self.levels.append(distinct(np.concatenate([k1, k2]), np.concatenate([d1, d2])))

    def _rank(self, i: int) -> int:
        return len(self.levels[i][0]).bit_length()


def distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array's distinct prefixes with the smallest document of each."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.minimum.reduceat(docs, at)


def prefixes(buf: bytes, start: np.ndarray, length: int) -> np.ndarray:
    """buf[s : s + length] for each start, as fixed-width byte strings (a last byte keeps trailing zeros)."""
    out = np.empty((len(start), length + 1), np.uint8)
    out[:, :length] = sliding_window_view(np.frombuffer(buf, np.uint8), length)[start]
    out[:, length] = 1
    return out.view(f"S{length + 1}").ravel()


def _windows(spec: Spec):
    def decide(r: Runs, i: np.ndarray) -> np.ndarray:
        n = r.n[i]
        before = np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(r.lo[i], n) + np.arange(len(before)) - before
        doc = np.repeat(r.doc[i], n)  # in ascending order, as i is
        bad = np.zeros(len(doc), bool)
        levels = SuffixLevels()
        for lo in range(0, len(doc), BATCH):
            keys = prefixes(r.buf, start[lo : lo + BATCH], spec.length)
            order = np.argsort(keys, kind="stable")
            s, d = keys[order], doc[lo : lo + BATCH][order]
            at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            known = levels.scan(s[at], np.minimum.reduceat(d, at))
            bad[lo + order] = d > np.repeat(known, np.diff(np.r_[at, len(s)]))
            if lo + BATCH < len(doc):
                levels.append(s[at], known)
        return bad

    return decide


def _make(length: int):
    def make(ids, null, texts, spans):
        array, lists = spans_array(spans, length)
        kept = []
        for t, mine in zip(texts, lists, strict=True):
            at, out = 0, []
            for a, b in mine:
                out.append(t[at:a])
                at = b
            kept.append(b"".join([*out, t[at:]]))
        return [id_array(ids), pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(b - a for a, b in m) for m in lists], pa.int64()), pa.array([len(m) for m in lists], pa.int64()), array, pa.array(kept, pa.binary())]

    return make


def _spec(length: int, k: int) -> Spec:
    if not 1 <= k <= length:
        raise ValueError("k must be from 1 to length")
    return Spec(length, k, words=False, across=True)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, k: int = 12) -> DataFrame:
    """Per document its UTF-8 bytes, the maximal spans covered by strings of `length` bytes that also
    start in a document with a smaller id, and the bytes that stay."""
    spec = _spec(length, k)
    return deduplicate(docs, id_col, text_col, spec, _windows(spec), SQL, _make(length))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", length: int = 50, k: int = 12) -> DataFrame:
    """The rows of docs with repeated spans cut out of the text. What is left of a character that was cut
    in two goes too. chars_col, where there is one, becomes the new length. A document of which nothing but white
    space is left goes; one from which nothing was cut stays as it is."""
    spec = _spec(length, k)
    make = _make(length)

    def cut(ids, null, texts, spans):
        _, _, removed, _, _, kept = make(ids, null, texts, spans)
        left = [None if no else x.decode("utf-8", "ignore") for no, x in zip(null, kept.to_pylist(), strict=True)]
        return [pa.array(left, pa.string()), removed]

    out = deduplicate(docs, id_col, text_col, spec, _windows(spec), "__text string, __removed long", cut, carry=True)
    _, names = flat(docs)
    out = out.where("__removed = 0 or __text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    text, n = position(names, text_col), position(names, chars_col) if chars_col in names else -1
    kinds = dict(out.dtypes)
    columns = [F.col("__text") if i == text else F.when(F.col("__removed") > 0, F.length("__text").cast(kinds[f"__c{i}"])).otherwise(F.col(f"__c{i}")) if i == n else F.col(f"__c{i}") for i in range(len(names))]
    return out.select(*[c.alias(f"__o{i}") for i, c in enumerate(columns)]).toDF(*names)
