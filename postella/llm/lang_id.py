"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of learning documents. A text is compressed in
blocks with every dictionary, and the smallest sum of sizes names its language; on a tie the first by name. Where the
runner-up is nearly as small, the verdict is marked as rejected.

The dictionaries hold a bounded sample of labelled rows: of each language the first `docs_per_language` learning documents by
a hash of their id, whole, as long as they have `bytes_per_language` bytes together; zstandard looks back no further. Documents
that are longer alone teach nothing. One pass over the learning documents finds them: a task keeps its first
few of each language. Predictions read whole texts, very long ones too.

Rows: one per document row; rows that repeat an id or a text get equal results. A text that is null, empty or has no
letter is `und` with score 0; so is every text where nothing could be learned. Documents with a null id, text or
language teach nothing. The language, source and id of a document are no inputs of its prediction. An empty table gives
no rows. Columns are taken by name, the first of those that clash; others don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, id_array, pick
from .lm_score import held_out

LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")
#: Bytes compressed at once.
BLOCK = 2000
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def normalise(text: bytes) -> bytes:
    return b" ".join(text.translate(LETTERS).split())


class Model:
    """Dictionaries by language, in the order of names."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        self.langs = [lang for lang, _ in dictionaries]
        how = zstandard.ZstdCompressionParameters(window_log=22, hash_log=18, chain_log=18, search_log=3, min_match=4, target_length=8, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.with_ = []
        for _, content in dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.with_.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

    def sizes(self, text: bytes) -> np.ndarray:
        x = normalise(text)
        blocks = [x[i : i + BLOCK] for i in range(0, len(x), BLOCK)] or [b""]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.with_], float)

    def predict(self, text: bytes, margin: float) -> tuple[str, float, bool]:
        if not self.langs or not _LETTER.search(text.decode()):
            return "und", 0.0, True
        s = self.sizes(text)
        at = int(s.argmin())
        p = np.exp2(s[at] - s)
        rest = np.delete(s, at)
        narrow = len(rest) > 0 and bool(rest.min() - s[at] < margin * rest.min())
        return self.langs[at], float(p[at] / p.sum()), narrow


def _first(mine: list[tuple], docs: int, size: int) -> list[tuple]:
    """The first of the rows in order that are so many and have so many bytes together, and the one that no longer fits, as
    what comes after it doesn't count either."""
    total = 0
    mine = sorted(mine)[:docs]
    for i, row in enumerate(mine):
        total += len(row[-1])
        if total > size:
            return mine[: i + 1]
    return mine


def _sample(docs_per_language: int, bytes_per_language: int):
    """The task's first documents of each language by hash."""

    def run(batches):
        kept: dict[str, list[tuple[int, int, bytes]]] = {}
        for b in batches:
            h, k = (b.column(i).to_numpy() for i in (0, 1))
            langs = b.column(2).to_pylist()
            worst = {lang: mine[-1][:2] for lang, mine in kept.items() if len(mine) == docs_per_language}
            for i in range(len(langs)):
                at = (int(h[i]), int(k[i]))
                # two texts may share an id, and are then told apart by what they say
                if langs[i] not in worst or at <= worst[langs[i]]:
                    x = normalise(b.column(3)[i].as_py().encode())
                    if len(x) <= bytes_per_language:
                        kept.setdefault(langs[i], []).append((*at, x))
            for lang, mine in kept.items():
                kept[lang] = _first(mine, docs_per_language, bytes_per_language)
        rows = [(h, k, lang, t) for lang, mine in kept.items() for h, k, t in mine]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["h", "k", "lang", "t"])

    return run


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, fold: int, docs_per_language: int, bytes_per_language: int) -> list[tuple[str, bytes]]:
    """The dictionaries; at most `bytes_per_language` for each language go to the driver, and back."""
    rows = pick(docs, k=(id_col, "long"), t=(text_col, "string"), lang=(lang_col, "string"))
    rows = rows.where(f"k is not null and t is not null and lang is not null and crc32(cast(k as string)) % {int(folds)} <> {int(fold)}")
    found = rows.select(F.xxhash64("k").alias("h"), "k", "lang", "t").mapInArrow(_sample(docs_per_language, bytes_per_language), "h long, k long, lang string, t binary")
    order = Window.partitionBy("lang").orderBy("h", "k", "t")  # of a few rows from each task
    so_far = F.sum(F.octet_length("t")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = found.withColumns({"nth": F.row_number().over(order), "size": so_far}).where((F.col("nth") <= docs_per_language) & (F.col("size") <= bytes_per_language))
    got = first.orderBy("lang", "nth").collect()
    content: dict[str, list[bytes]] = {}
    for r in got:
        content.setdefault(r.lang, []).append(bytes(r.t))
    return [(lang, b" ".join(texts).ljust(8)) for lang, texts in sorted(content.items())]  # zstandard takes 8 bytes or more


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, docs_per_language: int = 64, bytes_per_language: int = 4 << 20, margin: float = 0.02) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): held-out documents, those whose crc32(id as text) % folds
    == fold, teach nothing; score is the share of 2^-bytes; rejected says that the margin was narrow."""
    dictionaries = docs.sparkSession.sparkContext.broadcast(learn(docs, id_col, text_col, lang_col, folds, fold, docs_per_language, bytes_per_language))

    def run(batches):
        model = Model(dictionaries.value)
        for chunk in chunks(batches, 8 << 20):
            got = [model.predict(t, margin) for t in chunk.texts()]
            yield pa.RecordBatch.from_arrays([id_array(chunk.ids), pa.array(held_out(chunk.ids, folds, fold)), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], schema=_SCHEMA)

    return pick(docs, k=(id_col, "long"), t=(text_col, "string")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
