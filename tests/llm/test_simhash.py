"""SimHash components against all pairs."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from postella.llm import queries, simhash
from postella.llm.components import components, local_components
from postella.llm.simhash import bucket_links, fingerprints, keep_one, simhash_components, tables

from .conftest import SF, by_id, texts_of


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(len(rows), [(i, j) for i, j in combinations(range(len(rows)), 2) if (fp[i] ^ fp[j]).bit_count() <= 4])
    least = {}
    for (d, _), c in zip(rows, comp, strict=True):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    return by_id([(d, f"{f:016x}", least.get(c)) for (d, _), f, c in zip(rows, fp, comp, strict=True)])


def result(df):
    return by_id([(r.doc_id, f"{r.fp & 0xFFFFFFFFFFFFFFFF:016x}", r.component_id) for r in simhash_components(df).collect()])


def in_order(d):
    return {k: sorted(v) for k, v in d.items()}


def test_tricky(tricky):
    assert in_order(result(tricky)) == in_order(brute(texts_of(tricky)))


def test_empty(empty):
    assert simhash_components(empty).count() == 0 and keep_one(empty).count() == 0


def test_query(spark, documents):
    assert by_id(queries.op10_simhash_near_dedup(spark, SF).collect()) == brute(texts_of(documents))


def test_keep_one(tricky):
    rows = texts_of(tricky)
    want = sorted({c[1] for d, cs in brute(rows).items() for c in cs if c[1] is not None})
    kept = keep_one(tricky)
    assert kept.columns == tricky.columns and sorted(r[0] for r in kept.collect()) == want


def test_fingerprints_of_many_shapes():
    texts = ["", " ", "a", "a b c", "A b C d", "x " * 300, "é è à ù ô " * 7, "one two three four five"]
    assert [int(f) for f in fingerprints([t.encode() for t in texts])] == [brute_fingerprint(t) for t in texts]


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.lists(st.integers(0, 63), max_size=6)), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_links_of_buckets(near):
    centre = [0, 0xDEADBEEFCAFEF00D, 0x0123456789ABCDEF]
    rows = np.unique(np.array([(k, centre[c] ^ sum({1 << b for b in bits})) for k, c, bits in near], np.uint64), axis=0)
    key, fp = rows[:, 0].astype(np.int64), rows[:, 1]
    close = [(i, j) for i, j in combinations(range(len(fp)), 2) if key[i] == key[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= 4]
    a, b = bucket_links(key, fp)
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} <= set(close)
    assert local_components(len(fp), a, b).tolist() == brute_components(len(fp), close)


def test_a_bucket_of_very_many_near_copies():
    """All within six bits of one text's fingerprint: few rounds, whatever their number."""
    import time

    rng = np.random.default_rng(1)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(30_000)]
    fp = np.unique(np.array([0xDEADBEEFCAFEF00D ^ f for f in flips], np.uint64))
    began = time.process_time()
    a, b = bucket_links(np.zeros(len(fp), np.int64), fp)
    assert time.process_time() - began < 30 and (np.bitwise_count(fp[a] ^ fp[b]) <= 4).all()
    near_centre = np.flatnonzero(np.bitwise_count(fp ^ np.uint64(0xDEADBEEFCAFEF00D)) <= 4)
    assert len(np.unique(local_components(len(fp), a, b)[near_centre])) == 1


@pytest.mark.parametrize("rows", [1, 10**9, 10**11])
def test_each_near_pair_shares_a_bucket(rows):
    rng = np.random.default_rng(3)
    masks = tables(rows)
    assert all(int(m).bit_count() >= 20 for m in masks) and rows >> min(int(m).bit_count() for m in masks) <= 128
    for _ in range(300):
        flips = np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)))
        assert any(flips & m == 0 for m in masks)


def test_very_long_texts_in_steps(monkeypatch):
    texts = [b" ".join(b"w%d" % (i * i % 977) for i in range(n)) for n in (3, 99, 100, 101, 500, 7)] + [b""]
    whole = fingerprints(texts)
    monkeypatch.setattr(simhash, "STEP", 50)
    assert (fingerprints(texts) == whole).all()


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components_over_the_cluster(spark, shape):
    rng = np.random.default_rng(5)
    n = 60
    edges = {"path": [(i, i + 1) for i in range(n - 1)], "star": [(0, i) for i in range(1, n)], "random": [tuple(map(int, rng.integers(0, n, 2))) for _ in range(40)]}[shape]
    got = {r.node: r.root for r in components(spark.createDataFrame([(b - 30, a - 30) for a, b in edges], "u long, v long")).collect()}
    want = brute_components(n, edges)
    assert got == {i - 30: want[i] - 30 for i in range(n) if any(i in e and e[0] != e[1] for e in edges)}


def test_fingerprints_of_very_many_rows(tricky, monkeypatch):
    """Rows of hot fingerprints meet their names in several places, and get the same ones."""
    monkeypatch.setattr(simhash, "HOT_LEAST", 1)
    assert result(tricky) == brute(texts_of(tricky))
