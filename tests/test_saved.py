"""Saved indexes: what is stored beside the entries, growth by parts, snapshots, and queries through bitmaps."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from postella import build, load, save
from postella.operators import bitmaps, boolean, enrichment, lookup, markers, mining, similarity, specificity
from postella.plans.atlas import Atlas, merge
from postella.sources import tables
from postella.sources.manifest import Manifest

from .test_atlas import CELLS, mini, rows

TYPES = list(CELLS)


@pytest.fixture(scope="module")
def a(spark):
    return mini(spark).persist()


@pytest.fixture(scope="module")
def saved(spark, a, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("saved") / "i")
    save(a, path)
    return load(spark, path)


def scans(df) -> str:
    """Paths that a plan reads."""
    return " ".join(df.inputFiles())


COUNTED = {
    "F1": lambda a: lookup.gene_names(a),
    "F2": lambda a: lookup.cell_type_names(a, ["D1"]),
    "F5": lambda a: lookup.case_correct(a, ["a", "D"]),
    "A1": lambda a: lookup.gene_support(a, ["A", "B"], ["D1"]),
    "A2": lambda a: lookup.gene_support_by_type(a, ["A"]),
    "A3": lambda a: lookup.zero_support_count(a, ["D2"]),
    "A4": lambda a: lookup.total_cells(a, ["D1"]),
    "A8": lambda a: lookup.cells_in_index(a),
    "A11": lambda a: markers.score(a, ["D1.T"], ["D2.X"]),
    "A13": lambda a: markers.top_markers(a, ["D1.T"]),
    "A14": lambda a: markers.evaluate(a, ["a", "B"], ["D1.T"]),
    "A15": lambda a: specificity.cell_type_specificity(a, min_cells=1),
    "A16": lambda a: specificity.tissue_specificity(a, min_cells=1),
    "A17": lambda a: specificity.housekeeping(a, ["D1.T", "D1.U"], 0.4, 5),
    "F9": lambda a: lookup.posting_key(a, 3),
}


@pytest.mark.parametrize("name", sorted(COUNTED))
def test_what_counts_answer_reads_no_entries(a, saved, name):
    df = COUNTED[name](saved)
    assert "/expression" not in scans(df) and "/bitmaps" not in scans(df)
    assert rows(df, *df.columns) == rows(COUNTED[name](a), *df.columns)


@pytest.mark.parametrize("ask", [lambda a: boolean.find(a, ["A", "b", "-C"]), lambda a: boolean.find(a, ["-B", "-C"], ["D1"]), lambda a: enrichment.hyper_query(a, ["A"]), lambda a: markers.evaluate_all(a, ["A", "B"], ["D1.T"])])
def test_boolean_queries_read_bitmaps_alone(a, saved, ask):
    df = ask(saved)
    assert "/bitmaps" in scans(df) and "/expression" not in scans(df) and "/cells/" not in scans(df)
    assert rows(df, *df.columns) == rows(ask(a), *df.columns)


def test_names_are_looked_up_by_a_stored_key(saved):
    plan = lookup.case_correct(saved, ["a"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lc), EqualTo(lc,a)]" in plan or "In(lc" in plan


def test_merged_in_memory_keeps_what_is_stored(spark, a, saved):
    other = tables.merge_wide(saved, spark.createDataFrame([("c1", "T", 1.0), ("c2", "T", 2.0)], "cell string, cell_type1 string, A double"), "D3")
    assert rows(lookup.gene_support(other, ["A", "B"]), "gene", "n_cells") == [("A", 6), ("B", 6)]
    assert dict(rows(other.genes, "gene", "total_reads"))["A"] == 6 and boolean.find(other, ["A"]).count() == 6
    both = merge(Atlas(*(lookup.scoped(saved, t, ["D1"]) for t in (saved.expression, saved.cells, saved.cell_types)), 2), Atlas(*(lookup.scoped(saved, t, ["D2"]) for t in (saved.expression, saved.cells, saved.cell_types)), 2))
    assert rows(both.genes, "gene", "total_reads") == rows(a.genes, "gene", "total_reads")


def test_three_appends_are_one_build(spark, a, tmp_path):
    path = str(tmp_path / "i")
    kept = TYPES[:3]
    assert [tables.append(mini(spark, [k]), path) for k in kept] == [1, 2, 3]
    b = load(spark, path)
    for t in ("expression", "cells", "cell_types", "support", "genes"):
        x, y = getattr(a, t), getattr(b, t)
        assert rows(x, *sorted(x.columns)) == rows(y, *sorted(x.columns))
    for terms in (["A", "B"], ["-B", "-C"], ["*A", "*d"]):
        assert rows(boolean.find(b, terms), "cell_type", "cell_id") == rows(boolean.find(a, terms), "cell_type", "cell_id")
    # each snapshot stays as it was
    assert load(spark, path, 1).datasets() == ["D1"] and load(spark, path, 2).cells.count() == 5
    assert tables.compact(spark, path) == 4 and len(Manifest(spark, path).read()[1]["parts"]) == 1
    c = load(spark, path)
    assert rows(c.support, *sorted(c.support.columns)) == rows(a.support, *sorted(c.support.columns))
    tables.expire(spark, path)
    assert Manifest(spark, path).versions() == [4] and load(spark, path).cells.count() == 9
    assert len(list((tmp_path / "i/expression").glob("part=*"))) == 1
    with pytest.raises(ValueError, match="no snapshot 1"):
        load(spark, path, 1)


def test_appends_are_checked_and_repeatable(spark, tmp_path):
    path = str(tmp_path / "i")
    tables.append(mini(spark, TYPES[:1]), path, "one")
    assert tables.append(mini(spark, TYPES[:1]), path, "one") == 1
    with pytest.raises(ValueError, match="more than one index: D1.T"):
        tables.append(mini(spark, TYPES[:2]), path, "two")
    other = mini(spark, TYPES[1:2])
    other.qb = 3
    with pytest.raises(ValueError, match="quantisation"):
        tables.append(other, path)
    assert load(spark, path).cells.count() == 3


def test_a_crash_before_the_commit_leaves_the_old_index(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    tables.append(mini(spark, TYPES[:1]), path, "one")

    def dies(*_):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(Manifest, "commit", dies)
        with pytest.raises(RuntimeError):
            tables.append(mini(spark, TYPES[1:3]), path, "two")
    assert load(spark, path).cells.count() == 3
    tables.append(mini(spark, TYPES[1:3]), path, "two")
    assert load(spark, path).cells.count() == 9


def test_two_writers(spark, tmp_path, monkeypatch):
    """Another writer commits between this one's look and its commit: this one goes on from there; equal types are found."""
    path = str(tmp_path / "i")
    tables.append(mini(spark, TYPES[:1]), path, "one")
    plain = Manifest.commit

    def late(others):
        todo = list(others)

        def commit(self, version, snapshot):
            if todo:
                monkeypatch.setattr(Manifest, "commit", plain)
                tables.append(mini(spark, todo.pop()), path, "other")
            return plain(self, version, snapshot)

        return commit

    monkeypatch.setattr(Manifest, "commit", late([TYPES[1:2]]))
    assert tables.append(mini(spark, TYPES[2:3]), path, "mine") == 3
    assert load(spark, path).cells.count() == 9
    path = str(tmp_path / "j")
    monkeypatch.setattr(Manifest, "commit", late([TYPES[:1]]))
    with pytest.raises(ValueError, match="more than one index"):
        tables.append(mini(spark, TYPES[:1]), path, "mine")
    assert load(spark, path).cells.count() == 3


@pytest.mark.parametrize("seed", range(6))
def test_bitmaps_are_the_entries_way(spark, seed):
    """Random indexes with types of more than one block, random queries of all roles."""
    rng = random.Random(seed)
    sizes = {("D1", "T"): 3, ("D1", "U"): 40, ("D2", "X"): bitmaps.BITS + 5}
    parts = [spark.range(n).selectExpr(f"'{d}' dataset", f"'{lab}' label", "id cell") for (d, lab), n in sizes.items()]
    annotation = parts[0].union(parts[1].selectExpr("dataset", "label", "cell + 100")).union(parts[2])
    salt = rng.randrange(1000)
    entries = annotation.selectExpr("dataset", "cell", f"explode(filter(transform(sequence(0, 5), g -> if(pmod(hash(dataset, cell, g, {salt}), 10) < g + 2 and (cell < 40 or cell > 32700), g, null)), g -> g is not null)) g").selectExpr("dataset", "cell", "concat('g', g) gene", "1.0 value")
    plain = build(annotation, entries).persist()
    packed = Atlas(plain.expression, plain.cells, plain.cell_types, 2, plain.supports, plain.names, bitmaps.of_entries(plain.expression).persist())
    for _ in range(5):
        terms = [rng.choice(["", "*", "-", "*-"]) + f"g{i}" for i in rng.sample(range(6), rng.randrange(1, 5))]
        where = rng.choice([None, ["D1"], ["D2"]])
        x, y = (rows(boolean.find(one, terms, where), "dataset", "cell_type", "cell_id") for one in (plain, packed))
        assert x == y, terms
    plain.unpersist()


def test_dense_genes_are_mined_by_bitmaps(spark):
    """32 genes that most cells have: sets grow while they are frequent, and both ways agree."""
    n = 400
    annotation = spark.range(n).selectExpr("'D' dataset", "'T' label", "id cell")
    entries = annotation.selectExpr("dataset", "cell", "explode(filter(transform(sequence(0, 31), g -> if(pmod(hash(cell, g), 100) < 55, g, null)), g -> g is not null)) g").selectExpr("dataset", "cell", "concat('g', lpad(g, 2, '0')) gene", "1.0 value")
    one = build(annotation, entries).persist()
    genes = [f"g{i:02d}" for i in range(32)]
    found = [rows(mining.frequent_sets(one, genes, cutoff=85, exhaustive=e), "query", "n_cells") for e in (True, False)]
    assert found[0] == found[1] and max(q.count(",") for q, _ in found[0]) >= 2
    plan = mining.frequent_sets(one, genes[:4], cutoff=5, exhaustive=True)._jdf.queryExecution().toString()
    assert "Window" not in plan
    one.unpersist()


@pytest.mark.parametrize("k", [1, 2, 3, 10])
def test_similar_genes_by_bounds(spark, a, saved, k):
    """Against all genes counted, and no bitmap of a gene whose bound is too low is needed."""
    for terms in (["A"], ["*A", "*d"], ["-B"], ["nothing"]):
        x, y = (rows(similarity.similar_genes(one, terms, top_k=k), "gene", "jaccard", "overlap", "n") for one in (a, saved))
        assert x == y
    cells = {}
    for r in a.expression.collect():
        cells.setdefault(r.gene, set()).add((r.cell_type, r.cell_id))
    best = sorted(((len(v & cells["A"]) / len(v | cells["A"]), g) for g, v in cells.items() if g != "A"), reverse=True)[:k]
    assert [(r.gene, r.jaccard) for r in similarity.similar_genes(a, ["A"], top_k=k).collect()] == [(g, pytest.approx(j)) for j, g in reversed(best)]


def test_export(spark, a, tmp_path):
    out = lookup.gene_support_by_type(a, ["A", "B"])
    tables.to_csv(out, str(tmp_path / "x"))
    assert rows(spark.read.schema(out.schema).option("header", True).csv(str(tmp_path / "x")), *out.columns) == rows(out, *out.columns)


def test_an_empty_index(spark, tmp_path):
    empty = build(spark.createDataFrame([], "dataset string, label string, cell string"), spark.createDataFrame([], "dataset string, cell string, gene string, value double"))
    save(empty, str(tmp_path / "i"))
    b = load(spark, str(tmp_path / "i"))
    assert b.datasets() == [] and lookup.gene_names(b).count() == 0 and boolean.find(b, ["A"]).count() == 0
    tables.append(mini(spark), str(tmp_path / "i"))
    assert load(spark, str(tmp_path / "i")).cells.agg(F.count("*")).first()[0] == 9


def test_footprint(spark, a, tmp_path):
    save(a, str(tmp_path / "i"))
    got = {r.name: (r.files, r.bytes) for r in tables.footprint(spark, str(tmp_path / "i")).collect()}
    want = {n: sum(f.stat().st_size for f in (tmp_path / "i" / n).rglob("*.parquet")) for n in tables.TABLES}
    assert {n: b for n, (_, b) in got.items()} == want and all(n > 0 for n, _ in got.values())
