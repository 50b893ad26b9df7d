"""Benchmark decontamination with one Aho-Corasick automaton over the normalised items.

Items and documents are normalised alike: A-Z in lower case, words of letters, digits and anything
beyond ASCII. The automaton's symbols are words, so it has at most 13 nodes for each item word; it
scans each text once, and hits are mapped back to byte offsets of the original text. It is broadcast only if the
items' text has at most ITEM_BYTES, which bounds it; the driver never holds more than that. Beyond, the windows of the
items stay in the cluster and are joined: a bit filter of fixed size tells which windows of a text, read once as
well, may be an item's, and only those are shuffled, to meet the items' windows word for word. Both ways give
the same rows.

Rows: one per document row; rows that repeat an id or a text get equal results. A null or empty text has no
words. Ties: of windows that several items share all items count. Items without words match nothing; a null item id is
written as "null"; items that repeat an id count once. Very long texts are scanned whole. Empty tables of
documents give no rows, of items no hits. Columns are taken by name, the first of those that clash; `decontaminate`
reads no others, `keep_clean` returns all as they are.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Chunk, chunks, id_array, pick, pick_with_rest, released

TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
WINDOW = 13
#: Bytes of item text up to which the automaton is broadcast.
ITEM_BYTES = 2 << 20
#: Bits of the filter of items' windows.
SLOTS = 1 << 27
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_OUT = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, hit_words array<struct<first: long, end: long>>, hit_spans array<struct<first: long, end: long>>, whole boolean"
_HITS = "doc_id long, code long, size int, first long, words string"
#: The automaton that this worker has built last, by the key of its items.
_built: dict[str, "Automaton"] = {}


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    """All windows of an item; the item itself if it has fewer words, but some."""
    return [tuple(words[s : s + window]) for s in range(max(1, len(words) - window + 1))] if words else []


class Automaton:
    def __init__(self, items: list[tuple[str, str]], window: int):
        found: dict[tuple[int, ...], set[str]] = {}
        self.word: dict[bytes, int] = {}
        for item, text in items:
            for w in windows_of(text.encode().translate(TABLE).split(), window):
                found.setdefault(tuple([self.word.setdefault(x, len(self.word) + 1) for x in w]), set()).add(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in found.items():
            self.machine.add_word(key, (len(key), tuple(names)))
        self.any = bool(found)
        if self.any:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """First word and size of each window that hits, in order of their ends, and the items that hit."""
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.any and words:
            get = self.word.get
            for end, (n, names) in self.machine.iter(tuple([get(w, 0) for w in words])):
                items.update(names)
                found.append((end - n + 1, n))
        return found, items


def _merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of hit words from (first, size) of windows."""
    out: list[tuple[int, int]] = []
    for first, n in sorted(found):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], first + n))
        else:
            out.append((first, first + n))
    return out


def _result(chunk: Chunk, found: list[list[tuple[int, int]]], items: list, window: int, rest: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    total, n_hit, hits, places, whole = [], [], [], [], []
    for text, mine in zip(chunk.texts(), found, strict=True):
        total.append(len(text.translate(TABLE).split()))
        hits.append(_merged(mine))
        n_hit.append(sum(b - a for a, b in hits[-1]))
        where = [m.span() for m in WORD.finditer(text)] if mine else []
        places.append([(where[a][0], where[b - 1][1]) for a, b in hits[-1]])
        whole.append(any(n == window for _, n in mine))
    lists = [sorted(x) for x in items]
    columns = [id_array(chunk.ids), pa.array(total, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in lists], pa.int64()), pa.array(lists, pa.list_(pa.string())), _spans(hits), _spans(places), pa.array(whole, pa.bool_())]
    return pa.RecordBatch.from_arrays([*columns, *rest], names=names)


def _spans(lists: list[list[tuple[int, int]]]) -> pa.Array:
    flat = [x for m in lists for x in m]
    struct = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.int64()), pa.array([b for _, b in flat], pa.int64())], names=["first", "end"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(m) for m in lists])], pa.int32()), struct)


def _scanner(items, at: str, window: int, names: list[str]):
    @released
    def run(batches):
        if at not in _built:
            _built.clear()
            _built[at] = Automaton(items.value, window)
        for chunk in chunks(batches, 8 << 20):
            found = [_built[at].scan(t.translate(TABLE).split()) for t in chunk.texts()]
            rest = [chunk.column(i) for i in range(2, chunk.batch.num_columns)]
            yield _result(chunk, [f for f, _ in found], [x for _, x in found], window, rest, names)

    return run


def _slot(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) % SLOTS


def _item_windows(window: int):
    """(item, size, words, slot) of the windows of each item, each once an item."""

    @released
    def run(batches):
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                every = sorted(set(windows_of(text.encode().translate(TABLE).split(), window)))
                for lo in range(0, len(every), 10_000):
                    part = every[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array([len(w) for w in part], pa.int32()), pa.array([b" ".join(w).decode() for w in part], pa.string()), pa.array([_slot(w) for w in part], pa.int64())], names=["item", "size", "words", "slot"])

    return run


def _maybe(bits, sizes: list[int]):
    """Windows of the texts that may be an item's: (doc_id, code, size, first, words)."""

    @released
    def run(batches):
        names = [x.split()[0] for x in _HITS.split(", ")]
        for chunk in chunks(batches, 4 << 20):
            code = chunk.column(2)
            for i, t in enumerate(chunk.texts()):
                w = t.translate(TABLE).split()
                for m in sizes:
                    first = [s for s in range(len(w) - m + 1) if bits.value[(k := _slot(w[s : s + m])) >> 6] >> (k & 63) & 1]
                    if first:
                        n = len(first)
                        yield pa.RecordBatch.from_arrays([id_array(np.full(n, chunk.ids[i])), pa.array([code[i].as_py()] * n, pa.int64()), pa.array([m] * n, pa.int32()), pa.array(first, pa.int64()), pa.array([b" ".join(w[s : s + m]).decode() for s in first], pa.string())], names=names)

    return run


def _gathered(window: int, names: list[str]):
    """Results of texts (doc_id, text, found, items, more)."""

    @released
    def run(batches):
        for chunk in chunks(batches, 8 << 20):
            found = [[(x["first"], x["size"]) for x in f or ()] for f in chunk.column(2).to_pylist()]
            rest = [chunk.column(i) for i in range(4, chunk.batch.num_columns)]
            yield _result(chunk, found, [x or [] for x in chunk.column(3).to_pylist()], window, rest, names)

    return run


def _joined(rows: DataFrame, items: DataFrame, window: int, names: list[str], out: StructType) -> DataFrame:
    spark = rows.sparkSession
    known = items.mapInArrow(_item_windows(window), "item string, size int, words string, slot long")
    sizes = sorted(r.size for r in known.select("size").distinct().collect())  # up to `window` numbers
    marks = known.groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("b")).toArrow()
    bits = np.zeros(SLOTS >> 6, np.int64)  # at most so many rows, however many windows
    bits[marks.column(0).to_numpy()] = marks.column(1).to_numpy()
    coded = rows.withColumn("__code", F.xxhash64("text"))
    maybe = coded.select("doc_id", "text", "__code").mapInArrow(_maybe(spark.sparkContext.broadcast(bits), sizes), _HITS)
    # an item's windows are counted by what is in texts; a window of many items in many texts makes as many rows as there are hits
    hits = maybe.join(known.select("item", "size", "words"), ["size", "words"])
    per = hits.groupBy("doc_id", "code").agg(F.collect_set(F.struct("first", "size")).alias("found"), F.collect_set("item").alias("items"))
    per = per.select(F.col("doc_id").alias("__id"), F.col("code").alias("__hit"), "found", "items")
    met = coded.join(per, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__code") == F.col("__hit")), "left")
    return met.select("doc_id", "text", "found", "items", *rows.columns[2:]).mapInArrow(_gathered(window, names), out)


def _scan(rows: DataFrame, items: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """Rows (doc_id, text, more) as their results and more."""
    out = StructType.fromDDL(_OUT)
    for f in rows.schema.fields[2:]:
        out.add(f.name, f.dataType)
    wanted = pick(items, k=(item_id, "string"), t=(item_text, "string")).where("t is not null").select(F.coalesce("k", F.lit("null")).alias("k"), "t")
    if wanted.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0] <= ITEM_BYTES:
        listed = rows.sparkSession.sparkContext.broadcast([(r.k, r.t) for r in wanted.collect()])
        done = rows.mapInArrow(_scanner(listed, uuid.uuid4().hex, window, out.names), out)
    else:
        done = _joined(rows, wanted, window, out.names, out)
    return done.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document its words, the ranges of words inside any occurrence of an item's window, the items that
    occur (sorted), the hit ranges as byte offsets of the original text, n_hit, n_items, whether a whole window of
    `window` words occurs, and contaminated (any hit, and at least one word in twenty)."""
    return _scan(pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")), items, item_id, item_text, window)


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no whole window of an item and aren't contaminated. So a long
    document with one passage of the benchmark goes as well; one that only holds an item of fewer words than a window, in less
    than a twentieth of its own, stays."""
    rows, names = pick_with_rest(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    out = _scan(rows, items, item_id, item_text, window).where("not whole and not contaminated")
    return out.select(*[f"__c{i}" for i in range(len(names))]).toDF(*names)
