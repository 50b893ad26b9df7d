"""Sampled SentencePiece encoding and lossless decoding.

Encoding runs forward filtering over each unit's lattice and samples backwards, each text by a
random stream of its own row key and the seed: the same row has the same pieces whatever batch or
machine it falls to. Decoding joins the pieces' bytes.

Rows: one per document row. A null text has null pieces and decodes to null; an empty text has the one piece of
the leading space. A null id has a key of its own. Rows that repeat an id and a text get equal pieces; texts under one
id share random numbers. Very long texts, without spaces too, are encoded whole. Ties: segmentations of equal
weight are equally likely. An empty table gives no rows. Columns are taken by name, the first of those that clash;
`encode` reads no others, `decode` returns all as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, flat, id_array, mix, pick, position, released
from .lattice import UNIT, Lattice, Pieces, load

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose distinct units are held at once.
CHUNK = 2 << 20
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("pieces", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("lossless", pa.bool_())])


def encode_texts(table: Pieces, ids: np.ndarray, texts: list[bytes], seed: int, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all texts one after another, and how many each has."""
    known: dict[bytes, int] = {}
    index: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    put = known.setdefault
    for i, t in enumerate(texts):
        units = UNIT.findall(b" " + t)
        sizes[i] = len(units)
        index += [put(u, len(known)) for u in units]
    lattice = Lattice(table, list(known), table.log * alpha)
    lattice.sampler()
    unit = np.array(index, np.int64)
    row = mix(ids.astype(np.uint64) ^ mix(np.array([seed], np.uint64)))
    nth = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, counts = [], []
    for lo in range(0, len(unit), 1 << 18):
        part = slice(lo, lo + (1 << 18))
        key = mix(np.repeat(row, sizes)[part] + nth[part].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        p, c = lattice.sample(unit[part], key)
        out.append(p)
        counts.append(c)
    pieces = np.concatenate(out) if out else np.zeros(0, np.int32)
    ends = np.r_[0, np.cumsum(np.concatenate(counts) if counts else np.zeros(0, np.int64))]
    stops = np.r_[0, np.cumsum(sizes)]
    return pieces, np.diff(ends[stops])


def decode_pieces(table: Pieces, pieces: list[int]) -> bytes:
    return b"".join([table.raw[i] for i in pieces])[1:]


def _encoder(model: str, seed: int, alpha: float):
    @released
    def run(batches):
        table = load(model)
        for chunk in chunks(batches, CHUNK):
            texts = chunk.texts()
            pieces, counts = encode_texts(table, chunk.ids, texts, seed, alpha)
            counts[chunk.null] = 0  # the pieces of a null are none
            ends = np.r_[0, np.cumsum(counts)]
            if chunk.null.any():
                keep = np.repeat(~chunk.null, np.where(chunk.null, 1, counts))
                pieces = pieces[keep]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), pa.int32(), mask=np.r_[chunk.null, False]), pa.array(pieces))
            flatp = pieces.tolist()
            same = [bool(chunk.null[i]) or decode_pieces(table, flatp[ends[i] : ends[i + 1]]) == t for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([id_array(chunk.ids), lists, pa.array(counts, pa.int64()), pa.array(same)], schema=_SCHEMA)

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, seed: int = 0, alpha: float = 0.5) -> DataFrame:
    """(doc_id, pieces array<int>, n_pieces, lossless): one sampled segmentation per row; lossless says that
    the pieces decode to the text's very bytes. alpha flattens the weights (below 1) or sharpens them."""
    rows = pick(docs, k=(id_col, "long"), t=(text_col, "string"))
    return rows.mapInArrow(_encoder(model, seed, alpha), "doc_id long, pieces array<int>, n_pieces long, lossless boolean")


def decode(encoded: DataFrame, pieces_col: str = "pieces", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """The frame with a column `out` of decoded texts; other columns stay as they are."""

    @F.arrow_udf("string")
    def text(pieces: pa.Array) -> pa.Array:
        table = load(model)
        return pa.array([None if p is None else decode_pieces(table, p).decode() for p in pieces.to_pylist()], pa.string())

    plain, names = flat(encoded)
    return plain.withColumn("__out", text(F.col(f"__c{position(names, pieces_col)}"))).toDF(*names, out)
