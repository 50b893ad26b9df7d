"""Language-model scores: the marginal probability of a document over all its segmentations into pieces.

The pieces are those of an existing vocabulary. A text is a sequence of words, each its lower-case bytes after a
space, and an end; the lattice of the whole text is the product of its words' lattices, so its log likelihood
is the sum over words of the log-space forward recursion (``lattice.py``) and of the end:

    score = sum over words of log10((1 - e) P(word)) + log10(e),   e = (training documents + 1) / (N + 2).

Weights of pieces start from the vocabulary's scores (which are ranks of merges in the vocabulary at hand: a piece's
weight is Zipf's then) and are adapted by `steps` forward-backward steps over the counts of all training words, to which
the vocabulary's own weights add PRIOR uses. A piece that begins a word has the leading space, so P sums to one over
words. `mixture_score` puts the counts of whole words on top, as in Witten and Bell, with c of the word, N training
tokens and V distinct ones: P'(word) = (c + V (1 - e) P(word)) / (N + V). `base_score` is add-one over N + V + 1.

Counts, V and N are taken over all training documents. Words never go to the driver: each task
sends the distinct words of a piece of the corpus to the words' partitions, which answer with counts and
marginals; only the adapted piece weights (as many as the vocabulary has) and N and V are broadcast.

Rows: one per document row; rows that repeat an id or a text, ties among them, are scored alike and each counts
in training. A null text is empty: its only token is the end. A null id is not held out. A very long text or word is
scored whole. Without any training document the vocabulary's weights score. An empty table gives no rows. Columns are
taken by name, the first of those that clash; others don't matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import PARTS, PARTS_SQL, rows_of
from .common import NULL_ID, Chunk, checkpoint, chunks, id_array, pack, partitions, pick, to_part, unpack
from .lattice import Lattice, load
from .sentencepiece_codec import MODEL
from .simhash import LOWER

WORDS, ASK, BODY, ANSWER = 0, 1, 2, 3
#: Bytes of text whose distinct words are counted or asked for together.
GATHER = 24 << 20
#: Bytes of text whose words are asked for together.
ASKED = 8 << 20
#: Units whose lattices are held at once.
BLOCK = 50_000
#: Uses that the vocabulary's own weights count for beside those in the corpus.
PRIOR = 10_000.0
_COUNTS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("mixture_score", pa.float64())])
_SCORES_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mixture_score double"


def held_out(ids: np.ndarray, folds: int, fold: int) -> np.ndarray:
    return np.array([i != NULL_ID and zlib.crc32(str(i).encode()) % folds == fold for i in ids.tolist()], bool)


def _part_of(words: list[bytes], n: int) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(n)).astype(np.int64)


def _gathered(batches, most: int):
    """Chunks in groups of about `most` bytes."""
    group: list[Chunk] = []
    size = 0
    for chunk in chunks(batches, 4 << 20):
        group.append(chunk)
        size += len(chunk.data)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _counter(parts: int, folds: int, fold: int):
    def run(batches):
        from collections import Counter

        for group in _gathered(batches, GATHER):
            count: Counter[bytes] = Counter()
            docs = 0
            for chunk in group:
                out = held_out(chunk.ids, folds, fold)
                docs += int((~out).sum())
                for t, skip in zip(chunk.texts(), out, strict=True):
                    if not skip:
                        count.update(t.translate(LOWER).split())
            if docs:
                count[b""] = docs  # the end; no word is empty
            words, c = list(count), np.fromiter(count.values(), np.int64, len(count))
            yield from rows_of(_part_of(words, parts), WORDS, lambda i: ([words[j] for j in i], c[i]))  # noqa: B023

    return run


def _summed(batches):
    total: dict[bytes, int] = {}
    part = None
    for b in batches:
        for p, blob in zip(b.column(0).to_pylist(), b.column(2), strict=True):
            part = p
            for w, c in zip(*_lists(unpack(blob.as_py())), strict=True):
                total[w] = total.get(w, 0) + c
    if part is not None:
        c = np.fromiter(total.values(), np.int64, len(total))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([WORDS], pa.int32()), pa.array([pack((list(total), c))], pa.binary()), pa.array([int(c.sum())], pa.int64()), pa.array([len(c)], pa.int64())], schema=_COUNTS)


def _lists(pair):
    return pair[0], pair[1].tolist()


def _expectation(model: str, log: np.ndarray):
    def run(batches):
        table = load(model)
        out = np.zeros(table.size)
        for b in batches:
            for blob in b.column(2):
                words, c = unpack(blob.as_py())
                for lo in range(0, len(words), BLOCK):
                    units = [b" " + w for w in words[lo : lo + BLOCK] if w]
                    if units:
                        times = np.array([n for w, n in zip(words[lo : lo + BLOCK], c[lo : lo + BLOCK], strict=True) if w], float)
                        out += Lattice(table, units, log).expected(times, table.size)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out[at])], names=["piece", "uses"])

    return run


def _asker(parts: int, folds: int, fold: int, stride: int):
    def run(batches):
        task = TaskContext.get().partitionId()
        for nth, group in enumerate(_gathered(batches, ASKED)):
            known: dict[bytes, int] = {}
            put = known.setdefault
            index: list[np.ndarray] = []
            sizes: list[int] = []
            for chunk in group:
                mine: list[int] = []
                for t in chunk.texts():
                    w = t.translate(LOWER).split()
                    sizes.append(len(w))
                    mine += [put(x, len(known)) for x in w]
                index.append(np.array(mine, np.int32))
            ids = np.concatenate([c.ids for c in group])
            out = held_out(ids, folds, fold)
            every = np.concatenate(index)
            words = list(known)
            # The same rows make the same key when a lost task runs again; equal keys of equal rows share answers.
            key = xxhash.xxh3_128_digest(ids.tobytes() + every.tobytes() + b" ".join(words))
            home = (task * stride + nth) % parts  # as even as the tasks are
            yield pa.RecordBatch.from_arrays([pa.array([home], pa.int32()), pa.array([BODY], pa.int32()), pa.array([pack((key, ids, out, np.array(sizes), every, len(words)))], pa.binary())], schema=PARTS)
            yield from rows_of(_part_of(words, parts), ASK, lambda i: (key, home, i.astype(np.int32), [words[j] for j in i]))  # noqa: B023

    return run


def _answerer(model: str, log: np.ndarray):
    def run(batches):
        table = load(model)
        count: dict[bytes, int] = {}
        asked: list[bytes] = []
        for b in batches:
            kinds = b.column(1).to_numpy()
            if (kinds == BODY).any():
                yield b.filter(pa.array(kinds == BODY))
            for kind, blob in zip(kinds, b.column(2), strict=True):
                if kind == WORDS:
                    words, c = unpack(blob.as_py())
                    count.update(zip(words, c.tolist(), strict=True))
                elif kind == ASK:
                    asked.append(blob.as_py())
        known: dict[bytes, int] = {}
        for blob in asked:
            for w in unpack(blob)[3]:
                known.setdefault(w, len(known))
        words = list(known)
        marginal = np.zeros(len(words))
        for lo in range(0, len(words), BLOCK):
            marginal[lo : lo + BLOCK] = Lattice(table, [b" " + w for w in words[lo : lo + BLOCK]], log).log_likelihood
        c = np.fromiter((count.get(w, 0) for w in words), np.int64, len(words))
        for blob in asked:
            key, home, i, mine = unpack(blob)
            j = np.fromiter((known[w] for w in mine), np.int64, len(mine))
            yield pa.RecordBatch.from_arrays([pa.array([home], pa.int32()), pa.array([ANSWER], pa.int32()), pa.array([pack((key, i, c[j], marginal[j]))], pa.binary())], schema=PARTS)

    return run


def _scorer(n: int, v: int, ends: int):
    def run(batches):
        bodies: list[bytes] = []
        answers: dict[bytes, list[tuple]] = {}
        for b in batches:
            for kind, blob in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                if kind == BODY:
                    bodies.append(blob.as_py())
                else:
                    key, *rest = unpack(blob.as_py())
                    answers.setdefault(key, []).append(rest)
        weight = max(v, 1)
        end = (ends + 1) / (n + 2)
        for body in bodies:
            key, ids, out, sizes, every, m = unpack(body)
            c, lat = np.zeros(m, np.int64), np.zeros(m)
            for i, counts, marginal in answers.get(key, []):
                c[i], lat[i] = counts, marginal
            p_base = np.log10(c + 1) - np.log10(n + v + 1.0)
            p = lat / np.log(10) + np.log10(1 - end)
            with np.errstate(divide="ignore"):
                mixed = np.log10(c + weight * np.power(10, np.maximum(p, -300)))
            mixed = np.where((c == 0) & (p < -290), np.log10(weight) + p, mixed) - np.log10(n + weight)
            doc = np.repeat(np.arange(len(ids)), sizes)
            add = lambda x: np.bincount(doc, x[every], len(ids)) if len(every) else np.zeros(len(ids))  # noqa: B023, E731
            base = add(p_base) + np.log10(ends + 1) - np.log10(n + v + 1.0)
            score = add(p) + np.log10(end)
            mixture = add(mixed) + np.log10(ends + weight * end) - np.log10(n + weight)
            known = add((c > 0).astype(float)).astype(np.int64) + (ends > 0)
            yield pa.RecordBatch.from_arrays([id_array(ids), pa.array(out), pa.array(sizes + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(ids), n), pa.int64()), pa.array(base), pa.array(score), pa.array(mixture)], schema=_SCORES)

    return run


def _ends(blob_rows: DataFrame) -> DataFrame:
    """The training documents, as the count of the empty word in its partition."""

    def run(batches):
        for b in batches:
            for blob in b.column(2):
                words, c = unpack(blob.as_py())
                if b"" in words:
                    yield pa.RecordBatch.from_arrays([pa.array([int(c[words.index(b"")])], pa.int64())], names=["ends"])

    return blob_rows.mapInArrow(run, "ends long")


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, folds: int = 7, fold: int = 2, steps: int = 3) -> DataFrame:
    """Per document: whether crc32(id as text) % folds == fold (held out, not learned from), tokens, known tokens, training
    tokens, the add-one score of its tokens as base, the lattice's score, and the mixture's (all log10)."""
    rows = pick(docs, k=(id_col, "long"), t=(text_col, "string"))
    n = partitions(rows)
    counts = checkpoint(to_part(n, rows.mapInArrow(_counter(n, folds, fold), PARTS_SQL), "part").mapInArrow(_summed, "part int, kind int, blob binary, tokens long, distinct long"))
    tokens, distinct = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    ends = _ends(counts.where(F.col("part") == int(_part_of([b""], n)[0]))).agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0]
    log = load(model).log
    prior = np.exp(log) * PRIOR
    for _ in range(steps):
        uses = prior.copy()
        for r in counts.mapInArrow(_expectation(model, log), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            uses[r.piece] += r.uses  # at most one row for each piece of the vocabulary
        with np.errstate(divide="ignore"):
            log = np.log(uses / uses.sum())
    most = docs.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    asked = rows.mapInArrow(_asker(n, folds, fold, -(-most // ASKED)), PARTS_SQL).union(counts.select("part", "kind", "blob"))
    answers = to_part(n, asked, "part").mapInArrow(_answerer(model, log), PARTS_SQL)
    return to_part(n, answers, "part").mapInArrow(_scorer(int(tokens), int(distinct), int(ends)), _SCORES_SQL)
