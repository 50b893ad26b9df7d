"""The pipeline's near-duplicates against all pairs of five-word sets."""

from __future__ import annotations

import random
import re
from fractions import Fraction
from itertools import combinations

import numpy as np

import corpus_pipeline as pipeline
from postella.llm import components, set_dedup
from postella.llm.set_dedup import bitmap, candidates, differ, keep_one_similar, prefix

from .conftest import SF, texts_of
from .test_simhash import brute_components, lower


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def similar(a, b):
    return a == b or 10 * len(a & b) >= 8 * len(a | b)


def brute_kept(rows):
    s = [shingles(t) for _, t in rows]
    comp = brute_components(len(rows), [(i, j) for i, j in combinations(range(len(rows)), 2) if min(len(s[i]), len(s[j])) * 10 >= 8 * max(len(s[i]), len(s[j])) and similar(s[i], s[j])])
    least = {}
    for (d, _), c in zip(rows, comp, strict=True):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    return sorted(least.values())


def ids(df):
    return sorted(r[0] for r in df.collect())


def copies(seed=1):
    """Texts of many sizes, each with copies of which some words are replaced, and one common line."""
    rng = random.Random(seed)
    rows = []
    for size in (6, 20, 60, 200, 400):
        for _ in range(6):
            w = [f"w{rng.randrange(500)}" for _ in range(size)]
            for _ in range(5):
                x = list(w)
                for _ in range(rng.randrange(max(2, size // 30))):
                    x[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
                rows.append((len(rows) * 7 % 150, "all of this stands under one license " * (rng.random() < 0.5) + " ".join(x)))
    return rows


def test_stage_keeps_no_near_copies(spark):
    rows = copies()
    got = ids(pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF))
    assert got == brute_kept(rows) and len(got) < len(rows)


def test_documents(spark, documents):
    assert ids(keep_one_similar(documents)) == brute_kept([(r.doc_id, r.text) for r in documents.collect()])


def test_tricky(tricky, empty):
    kept = keep_one_similar(tricky)
    assert kept.columns == tricky.columns and ids(kept) == brute_kept(texts_of(tricky)) and keep_one_similar(empty).count() == 0


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(2)
    for _ in range(300):
        base = np.unique(rng.integers(0, 1 << 60, 90).astype(np.uint64))
        told = np.sort(rng.choice(base, 40, replace=False))
        rank = rng.integers(1, 9, 40)
        a, b = (np.unique(rng.choice(base, rng.integers(70, 90), replace=False)) for _ in "ab")
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(*(prefix(s, Fraction("0.8"), told, rank) for s in (a, b))))


def test_bitmaps_differ_in_no_more_than_sets():
    rng = np.random.default_rng(4)
    for n in (0, 1, 30, 31, 33, 600):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.r_[a[: n * 9 // 10], rng.integers(0, 1 << 62, n // 4).astype(np.uint64)])
        assert differ(bitmap(a), bitmap(b)) <= len(np.setxor1d(a, b)) and differ(bitmap(a), bitmap(a)) == 0


def test_candidates_between_components():
    """All pairs of different components within reach, though only those outside the largest are walked."""
    rng = np.random.default_rng(6)
    limit = Fraction("0.8")
    for _ in range(60):
        n = int(rng.integers(1, 40))
        key, size, pos = rng.integers(0, 3, n).astype(np.uint32), rng.integers(5, 30, n), rng.integers(0, 3, n)
        sid, comp = np.arange(n), rng.integers(0, 4, n)
        a, b = candidates(key, sid, size, pos, comp, limit, every=True)
        need = lambda x, y: -(-(x + y) * 4 // 9)
        want = {(i, j) for i, j in combinations(range(n), 2) if key[i] == key[j] and comp[i] != comp[j] and 10 * min(size[i], size[j]) >= 8 * max(size[i], size[j]) and min(size[i] - pos[i], size[j] - pos[j]) >= need(size[i], size[j])}
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def near_copies(n, seed=8):
    """Copies of one text with 1 to 6 of 150 words replaced: some similar to most others, some to few or none."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(150), rng.randrange(1, 7)):
            w[k] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    return rows


def test_a_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    verified, made = set_dedup._verified, []

    def counted(rows, least, pairs, words, limit):
        made.append(pairs.count())
        return verified(rows, least, pairs, words, limit)

    monkeypatch.setattr(set_dedup, "_verified", counted)
    rows = near_copies(150)
    assert ids(keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_kept(rows)
    assert 0 < sum(made) <= 10 * len(rows)


def tasks_of(spark, run):
    """What run returns, and how many tasks were done for it."""
    sc, group = spark.sparkContext, f"tasks_{random.random()}"
    sc.setJobGroup(group, "counted")
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    seen = sc.statusTracker()
    stages = {x for job in seen.getJobIdsForGroup(group) for x in seen.getJobInfo(job).stageIds}
    return out, sum(info.numCompletedTasks for x in stages if (info := seen.getStageInfo(x)))


def test_rounds_take_few_tasks(spark):
    """What each round makes is small; with many shuffle partitions it is their tasks that fill disks, by files and logs."""
    rows = near_copies(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        got, tasks = tasks_of(spark, lambda: ids(keep_one_similar(docs)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_kept(rows)
    assert 0 < tasks <= 85 * 40, tasks


def test_components_of_links_in_one_task_and_in_many(spark, monkeypatch):
    rng = random.Random(12)
    chain = [(i, i + 1) for i in range(-40, 60)]
    links = [*chain, *((y, x) for x, y in chain[::3]), *((rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)), (300, 300), (2**62, -(2**62))]
    names = sorted({x for link in links for x in link})
    comp = brute_components(len(names), [(names.index(a), names.index(b)) for a, b in links])
    least = {}
    for x, c in zip(names, comp, strict=True):
        least[c] = min(least.get(c, x), x)
    want = sorted((x, least[c]) for x, c in zip(names, comp, strict=True) if any(x in link and link[0] != link[1] for link in links))
    df = spark.createDataFrame(links, "u long, v long").repartition(5)
    for most in (components.LINKS, 150, 7):
        monkeypatch.setattr(components, "LINKS", most)
        assert sorted(map(tuple, components.components(df).collect())) == want
    assert components.components(df.limit(0)).count() == 0


def test_rounds_make_all_pairs():
    """Rounds over what is left of the buckets give the pairs of one round over all, in whatever order rows come."""
    rng = np.random.default_rng(9)
    limit = Fraction("0.8")
    for _ in range(60):
        n = int(rng.integers(1, 60))
        key, size, pos = rng.integers(0, 4, n).astype(np.uint32), rng.integers(5, 30, n), rng.integers(0, 3, n)
        sid, comp = rng.integers(0, 50, n), rng.integers(0, 50, 50)
        size, comp = size[sid % n], comp[sid]
        want = set(zip(*(x.tolist() for x in candidates(key, sid, size, pos, comp, limit, every=True)), strict=True))
        got, after, until = set(), 0, 1
        while len(key):
            at = rng.permutation(len(key))
            key, sid, size, pos, comp = (x[at] for x in (key, sid, size, pos, comp))
            got |= set(zip(*(x.tolist() for x in candidates(key, sid, size, pos, comp, limit, True, after, until)), strict=True))
            on = np.isin(sid, set_dedup.left(key, sid, size, comp, limit, until))
            key, sid, size, pos, comp = (x[on] for x in (key, sid, size, pos, comp))
            after, until = until, 2 * until
        assert got == want


def test_sketches_discard_no_similar_sets():
    rng = np.random.default_rng(10)
    limit, met, gone = Fraction("0.8"), 0, 0
    for n in (5, 30, 150, set_dedup.SKETCHED, set_dedup.SKETCHED + 60):
        base = np.unique(rng.integers(0, 1 << 62, n + n // 3).astype(np.uint64))
        for _ in range(60):
            a, b = (np.sort(rng.choice(base, n - int(rng.integers(0, 1 + n // 9)), replace=False)) if rng.random() < 0.5 else base[: n - int(rng.integers(0, 1 + n // 9))] for _ in "ab")
            size, bits = np.array([len(a), len(b)]), np.stack([np.frombuffer(set_dedup.sketch(s), np.uint64) for s in (a, b)])
            made = len(candidates(np.zeros(2, np.uint32), np.arange(2), size, np.zeros(2, np.int64), np.arange(2), limit, True, 0, None, bits)[0])
            both = len(np.intersect1d(a, b))
            if 10 * both >= 8 * (len(a) + len(b) - both):
                assert made
                met += 1
            gone += not made
    assert met and gone
