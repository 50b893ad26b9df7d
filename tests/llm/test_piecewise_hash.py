"""Fingerprints, their comparison, and the next document across parts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postella.llm import piecewise_hash, queries
from postella.llm.common import mix
from postella.llm.piecewise_hash import edit_distance, edited, fingerprint, likeness, piecewise_hashes

from .conftest import SF, by_id, pairs, passage, texts_of

LOW = -(1 << 63)


def plain_fingerprint(data: bytes) -> str:
    """Byte by byte: a hash of the last seven bytes, chunks by their bits, signs by their sums."""
    codes = [0] * 6 + [int(piecewise_hash._BYTE[c]) for c in data]
    h = []
    for i in range(len(data)):
        x = 0
        for c in codes[i : i + 7]:
            x = (x * 0xD6E8FEB86659FD93 + c) % 2**64
        h.append(x * int(piecewise_hash._ODD) % 2**64)
    k = 0
    while sum(x < 2 ** (63 - k) for x in h) >= piecewise_hash.MOST:
        k += 1
    out = [str(2 << k)]
    for j in range(k, k + 3):
        signs, total = "", 0
        for i, x in enumerate(h):
            total += x
            if x < 2 ** (63 - j) or i == len(h) - 1:
                n = int(mix(np.array([total % 2**64], np.uint64))[0]) & 4095
                signs += piecewise_hash.SIGNS[n >> 6] + piecewise_hash.SIGNS[n & 63]
                total = 0
        out.append(signs)
    return ":".join(out)


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def brute(rows):
    """Rows in the order of ids and texts, each with the one after it."""
    rows = sorted(rows, key=lambda r: (LOW if r[0] is None else r[0], r[1] is not None, (r[1] or "").encode()))
    out = []
    for i, (d, t) in enumerate(rows):
        t, u = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + u[:half]
        marks = [plain_fingerprint(x.encode()) if len(x) < 30_000 else fingerprint(x.encode()) for x in (t, new, u)]
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), marks[0], marks[1], likeness(*marks[:2]), likeness(marks[0], marks[2])))
    return by_id(out)


def result(df):
    return by_id([(r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest(), *r[3:]) for r in df.collect()])


@given(st.one_of(st.binary(max_size=400), st.text("ab", max_size=600).map(str.encode), st.text(max_size=200).map(str.encode)))
@settings(max_examples=60, deadline=None)
def test_fingerprint(data):
    assert fingerprint(data) == plain_fingerprint(data)


@pytest.mark.parametrize("n", [0, 1, 6, 7, 8, 127, 128, 129, 5000])
def test_lengths(n):
    for data in (b"a" * n, random.Random(n).randbytes(n), (b"abc " * n)[:n]):
        assert fingerprint(data) == plain_fingerprint(data)
        size, *signatures = fingerprint(data).split(":")
        assert all(len(s) <= 2 * piecewise_hash.MOST for s in signatures) and int(size) >= 2


def test_steps_and_bounds_of_what_is_held(monkeypatch):
    data = passage(60_000).encode()
    want = fingerprint(data)
    monkeypatch.setattr(piecewise_hash, "STEP", 1009)
    monkeypatch.setattr(piecewise_hash, "HELD", 300)
    assert fingerprint(data) == want


@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14))
@settings(max_examples=200, deadline=None)
def test_edit_distance(a, b):
    assert edit_distance(a, b) == table_distance(a, b)


def test_likeness():
    t, u = passage(800), passage(800, 3)
    a, b, c = (fingerprint(x.encode()) for x in (t, u, t[:3000] + " some words between " + t[3000:]))
    assert likeness(a, a) == 1 and likeness(a, b) < 0.1 and likeness(a, c) > 0.9 and likeness(a, b) == likeness(b, a)
    half = fingerprint(edited(t, u).encode())
    assert 0.35 < likeness(a, half) < 0.7
    empty = fingerprint(b"")
    assert likeness(empty, empty) == 1 and likeness(empty, a) == 0
    # sizes that differ twice are compared at the one that both have
    twice = fingerprint((t + u).encode())
    assert int(twice.split(":")[0]) > int(a.split(":")[0]) and 0.3 < likeness(a, twice) < 0.7
    assert likeness("2:AA:AA:AA", "4096:AA:AA:AA") == 0


def test_edited():
    assert edited("abcde", "xyz") == "abcxy" and edited("abcdef", "é") == "abcé" and edited("a", "b") == "a" and edited("", "b") == ""


def test_tricky(tricky):
    assert result(piecewise_hashes(tricky)) == brute(texts_of(tricky))


@pytest.mark.parametrize("size", [1, 40, 300])
def test_next_across_parts(spark, documents, monkeypatch, size):
    """The same rows whatever the parts, as many as documents or one."""
    monkeypatch.setattr(piecewise_hash, "PART_BYTES", size)
    rows = [(i * 3, f"t{i} " * (i % 5)) for i in range(40)] + [(9, "twin"), (9, "twin"), (9, "other"), (None, "no id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(piecewise_hashes(df)) == brute(rows)


def test_one_and_none(spark, empty):
    assert piecewise_hashes(empty).count() == 0
    one = piecewise_hashes(spark.createDataFrame([(1, "abcd efgh ijkl")], "doc_id long, text string")).collect()
    assert [(r.edited, r.near_next) for r in one] == [("abcd efabcd ef", 1.0)]


def test_whole_table(spark, documents):
    got = queries.op13_document_fingerprints(spark, SF).collect()
    texts = dict(pairs(documents))
    ids = sorted(texts)
    following = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    assert {r.doc_id for r in got} == set(ids)
    by_text = {}
    for r in got:
        t = texts[r.doc_id] or ""
        assert r.edited_sha256 == hashlib.sha256(edited(t, texts[following[r.doc_id]] or "").encode()).hexdigest() and r.n_chars == len(t)
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    marks = {r.doc_id: r.fingerprint for r in got}
    assert all(r.near_next == likeness(r.fingerprint, marks[following[r.doc_id]]) for r in got)
    long = [r for r in got if r.n_chars >= 100]
    assert np.mean([r.near_edited > 0.25 for r in long]) > 0.97 and np.mean([r.near_next < 0.15 for r in long if texts[r.doc_id] != texts[following[r.doc_id]]]) > 0.97
