"""Language identification: the sample, ties, long and repeated texts; predictions against a plain version."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from postella.llm.lang_id import Model, _first, _sample, identify, learn, normalise

from .conftest import by_id

SCHEMA = "doc_id long, text string, lang string"
EN, DE = "the man and the dog went to town with all of them", "der mann und der hund gingen mit allen in die stadt"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_whole_rows_up_to_a_bound():
    rows = [(3, 0, b"cc"), (1, 0, b"a" * 5), (2, 0, b"b" * 4), (4, 0, b"d")]
    assert _first(rows, 4, 9) == [(1, 0, b"aaaaa"), (2, 0, b"bbbb"), (3, 0, b"cc")] and _first(rows, 1, 99) == [(1, 0, b"aaaaa")] and _first(rows, 4, 99) == sorted(rows)


def test_sample_does_not_depend_on_batches():
    rng = np.random.default_rng(2)
    rows = [(int(h), i, "ab"[i % 2], f"text {i} " * (i % 50)) for i, h in enumerate(rng.integers(0, 10**6, 500))]
    schema = pa.schema([("h", pa.int64()), ("k", pa.int64()), ("lang", pa.string()), ("t", pa.string())])

    def sample(step):
        batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[i : i + step]], schema=schema) for i in range(0, len(rows), step)]
        return sorted(map(repr, (r for b in _sample(20, 300)(batches) for r in b.to_pylist())))

    want = []
    for x in "ab":
        short = [(h, k, lang, normalise(t.encode())) for h, k, lang, t in sorted(rows) if lang == x and len(normalise(t.encode())) <= 300]
        whole = [r for i, r in enumerate(short) if sum(len(y[3]) for y in short[:i]) <= 300][:20]
        want += [repr(dict(zip(("h", "k", "lang", "t"), r, strict=True))) for r in whole]
    want.sort()
    assert sample(500) == sample(7) == sample(1) == want


def test_ties_go_to_the_first_name(spark):
    train = [(i, EN, lang) for lang, i in zip(["zz", "aa"], [i for i in range(20) if not held(i)], strict=False)]
    rows = [*train, *[(i, EN, None) for i in range(100, 140)]]
    got = identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.lang_pred for r in got} == {"aa"} and all(r.rejected for r in got) and {round(r.score, 9) for r in got} == {0.5}


def test_long_repeated_and_clashing_rows(spark):
    rows = [(i, f"{EN} {i}", "en") for i in range(40)] + [(i, f"{DE} {i}", "de") for i in range(40, 80)]
    rows += [(1000, "中" + (DE + " ") * 40_000, None), (1001, DE, None), (1001, DE, None), (1001, EN, None), (None, EN, "de")]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.selectExpr("doc_id", "text", "lang", "'no' x", "1 k", "2 t", "3 h").toDF("doc_id", "text", "lang", "LANG", "k", "t", "h")
    got = by_id([(r.doc_id, r.lang_pred) for r in identify(df).collect()])
    assert got[1000] == [("de",)] and sorted(got[1001]) == [("de",), ("de",), ("en",)] and got[None] == [("en",)]


def test_sample_and_predictions_of_the_table(spark, documents):
    rows = [(r.doc_id, r.text, r.lang) for r in documents.collect()]
    h = {r.doc_id: r.h for r in documents.selectExpr("doc_id", "xxhash64(doc_id) h").collect()}
    dictionaries = learn(documents, "doc_id", "text", "lang", 4, 2, 7, 20_000)
    for lang, content in dictionaries:
        mine = [normalise(t.encode()) for _, _, t in sorted((h[d], d, t) for d, t, x in rows if x == lang and not held(d) and len(normalise(t.encode())) <= 20_000)][:7]
        assert content == b" ".join(t for i, t in enumerate(mine) if sum(map(len, mine[: i + 1])) <= 20_000)
    model = Model(dictionaries)
    got = {r.doc_id: r for r in identify(documents, docs_per_language=7, bytes_per_language=20_000).collect()}
    for d, t, _ in rows:
        size = [sum(len(c.compress(x)) for x in ([normalise(t.encode())[i : i + 2000] for i in range(0, len(normalise(t.encode())), 2000)] or [b""])) for c in model.with_]
        p = np.exp2(min(size) - np.array(size, float))
        assert got[d].lang_pred == model.langs[int(np.argmin(size))] and got[d].score == pytest.approx(float(p.max() / p.sum()))
