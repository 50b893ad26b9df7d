"""Quality rules: hard limits on document statistics, and gradient-boosted trees over more of them.

The trees learn from at most `max_labelled` labelled rows, the first in the order
of a hash of their id; statistics and verdicts cover all documents. Trees are flattened into node
arrays and score whole batches at once. More symbols, repeats, capitals and exclamation marks may only lower
a document's score (monotonic constraints).

Rows: one per document row; rows that repeat an id or a text get equal results. A null or empty text has no words, and
so fails; a very long one is counted whole. Without labels of both kinds there is no model and the limits alone decide
(score null). A label row without id or quality is left out; an id that stands in several rows of labels or of documents
teaches once for each pair. Ties: a score of just `least` is kept, values equal to a node's threshold go left. An
empty table gives no rows. Columns are taken by name, the first of those that clash; `assess` reads no others,
`keep_good` returns all as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import grams
from .common import Chunk, chunks, flat, id_array, mix, pick, position
from .gbt import Trees, fit

#: Feature names with the sign of their constraint.
FEATURES = {"log_words": 0, "mean_word": 0, "symbols": -1, "duplicate_lines": -1, "repeated": -1, "capitals": -1, "digits": 0, "exclamations": -1, "bars": -1, "stops": 0, "commas": 0, "line_words": 0, "beyond_ascii": 0, "letters": 0, "short_words": 0}
SPACE = frozenset(b" \t\n\v\f\r")
MIN_WORDS, REPEATED_PERCENT, REPEAT_WINDOW = 10, 20, 5
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])
_SQL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_IS = {
    "space": _table(bytes(SPACE)), "symbol": _table(b"#*$%&|<>"), "upper": _table(bytes(range(65, 91))), "digit": _table(b"0123456789"), "bang": _table(b"!"),
    "bar": _table(b"|"), "stop": _table(b"."), "comma": _table(b","), "cont": _table(bytes(range(128, 192))), "high": _table(bytes(range(192, 256))),
    "lower": _table(bytes(range(97, 123))), "newline": _table(b"\n"),
}


def _per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[offs[1:]] - run[offs[:-1]]


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and word offsets of documents."""
    inside = ~_IS["space"][data]
    before = np.r_[False, inside[:-1]]
    before[offs[:-1][offs[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.r_[inside[1:], False]
    last = offs[1:][offs[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes."""
    size = ends - starts
    h = np.zeros(len(starts), np.uint64)
    value = mix(np.arange(1, 257, dtype=np.uint64))
    live = np.arange(len(starts))
    at = 0
    while len(live):
        h[live] = h[live] * np.uint64(0x9E3779B97F4A7C15) + value[data[starts[live] + at]]
        at += 1
        live = live[size[live] > at]
    return mix(h + size.astype(np.uint64))


def statistics(chunk: Chunk) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of the contract, and the features of the trees."""
    data, offs, n = chunk.data, chunk.offs, len(chunk)
    count = {k: _per_doc(t[data], offs) for k, t in _IS.items()}
    starts, ends, woffs = _words(data, offs)
    words = np.diff(woffs)
    size = np.diff(offs)
    chars = size - count["space"] - count["cont"]
    # words in windows that occur twice or more in their document
    repeated = np.zeros(n, np.int64)
    if len(starts) >= REPEAT_WINDOW:
        doc = np.repeat(np.arange(n), words)
        g = grams(word_hashes(data, starts, ends), REPEAT_WINDOW)
        m = len(g)
        whole = doc[:m] == doc[REPEAT_WINDOW - 1 :]
        at = np.flatnonzero(whole)
        key = mix(g[at] ^ (doc[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        order = np.argsort(key)
        s = key[order]
        same = s[1:] == s[:-1]
        twice = at[order[np.r_[False, same] | np.r_[same, False]]] if len(s) else at
        mark = np.zeros(len(starts) + 1, np.int64)
        np.add.at(mark, twice, 1)
        np.add.at(mark, twice + REPEAT_WINDOW, -1)
        covered = np.cumsum(mark[:-1]) > 0
        repeated = np.bincount(doc, covered, n).astype(np.int64)
    duplicate = np.zeros(n, np.int64)
    lines = np.zeros(n, np.int64)
    for i, t in enumerate(chunk.texts()):
        with_word = [x for x in t.split(b"\n") if x.strip()]  # strips just the spaces of the word pattern
        lines[i] = len(with_word)
        duplicate[i] = len(with_word) - len(set(with_word))
    short = np.bincount(np.repeat(np.arange(n), words), (ends - starts) <= 3, n) if len(starts) else np.zeros(n)
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    counts = {"n_words": words, "word_chars": chars, "n_symbols": count["symbol"], "n_dup_lines": duplicate, "n_repeat_words": repeated}
    features = [np.log1p(words), chars / w, count["symbol"] / c, duplicate / np.maximum(lines, 1), repeated / w, count["upper"] / c, count["digit"] / c, count["bang"] / w, count["bar"] / w, count["stop"] / w, count["comma"] / w, words / np.maximum(lines, 1), count["high"] / c, (count["lower"] + count["upper"]) / c, short / w]
    return counts, np.stack(features, 1).astype(float)


def _features(batches):
    for chunk in chunks(batches, 4 << 20):
        _, x = statistics(chunk)
        yield pa.RecordBatch.from_arrays([id_array(chunk.ids), chunk.column(2).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["k", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str, max_labelled: int) -> Trees | None:
    """Trees from a bounded sample of labelled documents; the sample's statistics go to the driver, its texts don't."""
    sample = pick(labels, k=(label_id, "long"), quality=(label_col, "int")).where("k is not null and quality in (0, 1)").orderBy(F.xxhash64("k"), "k", "quality").limit(max_labelled)
    rows = pick(docs, k=(id_col, "long"), t=(text_col, "string")).join(F.broadcast(sample), "k").select("k", "t", "quality")
    # repeated ids can make more rows than the sample has
    got = rows.mapInArrow(_features, "k long, quality int, x array<double>").orderBy(F.xxhash64("k"), "k", "quality", "x").limit(max_labelled).collect()
    y = np.array([r.quality for r in got], float)
    if len(np.unique(y)) < 2:
        return None
    x = np.array([r.x for r in got])
    order = np.lexsort((*x.T, y))  # sums don't depend on the order in which tasks end
    return fit(x[order], y[order], np.array(list(FEATURES.values())))


def _verdicts(trees: Trees | None, least: float):
    def run(batches):
        for chunk in chunks(batches, 4 << 20):
            c, x = statistics(chunk)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEATED_PERCENT * c["n_words"])
            score = trees.predict(x) if trees else None
            kept = ~failed & (score >= least if trees else True)
            yield pa.RecordBatch.from_arrays([id_array(chunk.ids), *[pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], pa.array(failed), pa.array(score) if trees else pa.nulls(len(chunk), pa.float64()), pa.array(kept)], schema=_SCHEMA)

    return run


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", max_labelled: int = 20_000, least: float = 0.5) -> DataFrame:
    """Per document the counts, whether the limits reject it, the trees' score (probability of good quality), and
    whether it is kept: within the limits and scored `least` or more."""
    trees = train(docs, labels, id_col, text_col, label_id, label_col, max_labelled)
    return pick(docs, k=(id_col, "long"), t=(text_col, "string")).mapInArrow(_verdicts(trees, least), _SQL)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs, all columns as they are, that `assess` keeps; decided row by row, without a join."""
    trees = train(docs, labels, id_col, text_col, kw.get("label_id", "doc_id"), kw.get("label_col", "quality"), kw.get("max_labelled", 20_000))
    verdict = _verdicts(trees, kw.get("least", 0.5))

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([pa.nulls(len(text), pa.int64()), text], names=["k", "t"])
        return pa.concat_arrays([b.column(8) for b in verdict([batch])] or [pa.array([], pa.bool_())])

    plain, names = flat(docs)
    return plain.where(good(F.col(f"__c{position(names, text_col)}").cast("string"))).toDF(*names)
