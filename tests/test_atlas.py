"""The hand-computed mini atlas."""

from __future__ import annotations

import math
import warnings

import pytest
from pyspark.sql import functions as F

from postella import build, load, merge, save
from postella.functions.text import locus_name, peak_name, split_query
from postella.operators import boolean, codec, display, enrichment, intervals, lookup, markers, mining, similarity, specificity
from postella.plans.query import parse, role_of
from postella.sources import tables
from postella.sources.manifest import Manifest

CELLS = {
    ("D1", "T"): [("t1", dict(A=3, B=1, chr1_10_20=1)), ("t2", dict(A=2, C=4)), ("t3", dict(A=1, B=2, C=1))],
    ("D1", "U"): [("u1", dict(B=5, d=1)), ("u2", dict(B=1, C=1, chr1_10_20=2))],
    ("D2", "X"): [("x1", dict(A=1, B=1)), ("x2", dict(C=2, d=1)), ("x3", dict(B=1, C=2)), ("x4", {})],
    ("D1", "Z"): [("z1", dict(A=9))],
}


def mini(spark, keys=tuple(CELLS)):
    cells = [(d, lab, c) for (d, lab) in keys for c, _ in CELLS[d, lab]]
    entries = [(c, g, float(v)) for k in keys for c, gs in CELLS[k] for g, v in gs.items()]
    return build(spark.createDataFrame(cells, "dataset string, label string, cell string"), spark.createDataFrame(entries or [("", "", 0.0)], "cell string, gene string, value double"))


@pytest.fixture(scope="module")
def a(spark):
    return mini(spark).persist()


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cell_type, set()).add(r.cell_id)
    return out


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_build_drops_small_types_and_keeps_empty_cells(a):
    assert rows(a.cell_types, "cell_type", "total_cells") == [("D1.T", 3), ("D1.U", 2), ("D2.X", 4)]
    assert rows(lookup.cell_meta(a, "D2.X", 4), "reads", "features") == [(0.0, 0)]
    assert rows(lookup.cell_meta(a, "D1.T", 3), "reads", "features") == [(4.0, 3)]
    assert rows(lookup.gene_names(a), "gene") == [("A",), ("B",), ("C",), ("chr1_10_20",), ("d",)]


@pytest.mark.parametrize(
    ("terms", "want"),
    [
        (["A", "B"], {"D1.T": {1, 3}, "D2.X": {1}}),
        (["A", "-C"], {"D1.T": {1}, "D2.X": {1}}),
        (["*A", "*d"], {"D1.T": {1, 2, 3}, "D1.U": {1}, "D2.X": {1, 2}}),
        (["-B", "-C"], {"D1.T": {1, 2}, "D1.U": {1}, "D2.X": {1, 2, 4}}),
        (["-B"], {"D1.T": {2}, "D2.X": {2, 4}}),
        (["*-B", "-*C"], {"D2.X": {4}}),
        (["a", "D"], {}),
        (["nothing"], {}),
        (["nothing", "-B"], {"D1.T": {2}, "D2.X": {2, 4}}),
    ],
)
def test_boolean(a, terms, want):
    assert found(boolean.find(a, terms)) == want


def test_boolean_in_datasets(a):
    assert found(boolean.find(a, ["A", "B"], ["D2"])) == {"D2.X": {1}}
    assert {r.cell_type: r.cell_ids for r in boolean.cells_by_type(boolean.find(a, ["A"])).collect()} == {"D1.T": [1, 2, 3], "D2.X": [1]}


@pytest.mark.parametrize(
    "ask",
    [
        lambda a, d: boolean.find(a, ["A"], d),
        lambda a, d: boolean.find(a, ["-A"], d),
        lambda a, d: boolean.find(a, ["nothing"], d),
        lambda a, d: enrichment.hyper_query(a, ["A"], d),
        lambda a, d: lookup.cell_type_names(a, d),
        lambda a, d: lookup.query_genes(a, ["A"], d),
        lambda a, d: lookup.gene_support(a, ["A"], d),
        lambda a, d: lookup.gene_support_by_type(a, ["A"], d),
        lambda a, d: lookup.zero_support_count(a, d),
        lambda a, d: lookup.total_cells(a, d),
        lambda a, d: specificity.cell_type_specificity(a, datasets=d),
        lambda a, d: similarity.similar_genes(a, ["A"], d),
        lambda a, d: mining.tfidf(a, ["A"], d),
        lambda a, d: mining.marker_genes(a, ["A", "B"], d),
        lambda a, d: mining.frequent_sets(a, ["A", "B"], d),
    ],
)
def test_unknown_datasets_are_errors(a, ask):
    with pytest.raises(ValueError, match="unknown datasets"):
        ask(a, ["D1", "D9"])
    ask(a, ["D1"])


def test_complements_add_up(a):
    total = a.cells.count()
    for g in "ABCd":
        assert boolean.find(a, [g]).count() + boolean.find(a, [f"-{g}"]).count() == total


def test_parse():
    assert [role_of(t) for t in ("x", "*x", "-x", "*-x", "-*x")] == [("required", "x"), ("any_of", "x"), ("excluded", "x"), ("excluded_any", "x"), ("excluded_any", "x")]
    with pytest.warns(UserWarning, match="more than one operator"):
        parse(["x", "-x"], lambda names: {n: n for n in names})
    assert parse(7, lambda n: {}).genes == []
    same = lambda names: {n: n for n in names}
    for terms in (["g", "*g"], ["-g", "*-g"], ["*g", "-g"], ["*g", "-*g"], ["g", "-*g"]):
        with pytest.warns(UserWarning, match="more than one operator: g"):
            parse(terms, same)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        parse(["g", "g", "*h", "-i", "*-j"], same)


def test_names(a):
    assert lookup.resolve_genes(a, ["a", "D", "B"]) == {"a": "A", "D": "d", "B": "B"}
    assert rows(lookup.case_correct(a, ["D", "a", "A"]), "position", "gene") == [(1, "d"), (2, "A")]
    assert lookup.select_datasets(a, None) == ["D1", "D2"]
    with pytest.raises(ValueError, match="unknown"):
        lookup.select_datasets(a, ["D9"])
    assert split_query(" a,b\n c,,") == ["a", "b", "c"]


def test_supports(a):
    assert rows(lookup.gene_support(a, ["A", "B", "C", "d", "q"]), "gene", "n_cells") == [("A", 4), ("B", 6), ("C", 5), ("d", 2), ("q", 0)]
    assert rows(lookup.zero_support_genes(a, ["D2"]), "gene") == [("chr1_10_20",)]
    assert rows(lookup.total_cells(a, ["D1"]), "total_cells", "n_cell_types") == [(5, 2)]
    assert rows(lookup.cell_type_support(a, ["D2.X", "no", "D2.X"]), "position", "total_cells") == [(1, 4), (2, 0), (3, 4)]
    assert rows(lookup.posting_lists(a).where("gene = 'C' and cell_type = 'D2.X'"), "n_cells", "idf") == [(2, 1.0)]


def test_enrichment_against_direct_sums(a):
    def tail(x, m, u, k):
        return sum(math.comb(m, i) * math.comb(u - m, k - i) for i in range(x + 1, min(k, m) + 1) if k - i <= u - m) / math.comb(u, k)

    got = {r.cell_type: r for r in enrichment.hyper_query(a, ["A"]).collect()}
    assert {t: (r.cell_hits, r.total_cells) for t, r in got.items()} == {"D1.T": (3, 3), "D2.X": (1, 4)}
    p = {"D1.T": tail(3, 3, 7, 4), "D2.X": tail(1, 4, 7, 4)}
    order = sorted(p, key=p.get)
    run = 0.0
    for i, t in enumerate(order):
        run = max(run, (3 - i) * p[t])
        assert got[t].pval == pytest.approx(min(1, run), abs=1e-9)
    assert enrichment.hyper_query(a, ["chr1_10_20"], ["D2"]).count() == 0


def test_markers(a):
    r = markers.score(a, ["D1.T"], genes=["A"]).first()
    assert (r.tp, r.fp, r.fn) == (3, 1, 0) and (r.precision, r.recall) == (0.75, 1.0) and r.f1 == pytest.approx(6 / 7)
    assert markers.score(a, ["D1.T"], background=["D2.X"], genes=["A"]).first().fp == -2
    assert [x.gene for x in markers.top_markers(a, ["D1.T"], top_k=2).collect()][0] == "A"
    assert markers.top_markers(a, ["D1.T"], top_k=100).count() == 4
    with pytest.warns(UserWarning, match="f1"):
        asc = [x.f1 for x in markers.evaluate(a, ["a", "B"], ["D1.T"], sort_field="odd").collect()]
    assert asc == sorted(asc)
    both = {x.cell_type: (x.tp, x.fp, x.fn) for x in markers.evaluate_all(a, ["A", "B"], ["D1.T", "D1.U"]).collect()}
    assert both == {"D1.T": (2, 1, 1), "D1.U": (0, 3, 0)}


def test_marker_scores_where_nothing_else_has_the_gene(spark, a):
    """tp 3 of 3, fp -3: nothing false, so precision is infinite and f1 is twice the recall."""
    r = {x.gene: x for x in markers.score(a, ["D1.T"], background=["D1.U"]).collect()}
    assert (r["A"].tp, r["A"].fp, r["A"].fn) == (3, -3, 0) and r["A"].precision == math.inf and r["A"].f1 == 2.0
    assert (r["B"].precision, r["B"].recall) == (1.0, pytest.approx(2 / 3))
    best = markers.top_markers(a, ["D1.T"], ["D1.U"], top_k=4).collect()
    assert best[0].gene == "A" and [x.f1 for x in best] == sorted((x.f1 for x in best), reverse=True)
    up = [x.gene for x in markers.evaluate(a, ["A", "B", "C"], ["D1.T"], ["D1.U"], "precision").collect()]
    assert up[-1] == "A"
    none = markers.evaluate_all(a, ["A", "d"], ["D1.T"]).first()
    assert (none.tp, none.fp, none.fn, none.precision, none.recall, none.f1) == (0, 0, 0, None, None, None)
    some = markers.evaluate_all(a, ["B", "d"], ["D1.T", "D1.U"])
    assert {x.cell_type: (x.precision, x.recall, x.f1) for x in some.collect()}["D1.T"] == (0.0, None, None)
    assert markers.evaluate_all(a, ["A", "B"], ["D1.T"], ["D2.X"]).first().tp == 0


def test_cells_of_datasets_are_apart(spark):
    """Datasets name cells alike; a value goes to its own dataset's cell."""
    cells = [(d, "T", c) for d in ("D1", "D2") for c in ("c1", "c2")]
    entries = [("D1", "c1", "A", 1.0), ("D2", "c1", "B", 5.0), ("D1", "c2", "A", 2.0), ("D2", "c2", "A", 7.0)]
    annotation = spark.createDataFrame(cells, "dataset string, label string, cell string")
    both = build(annotation, spark.createDataFrame(entries, "dataset string, cell string, gene string, value double"))
    want = [("D1.T", 1, "A", 1.0), ("D1.T", 2, "A", 2.0), ("D2.T", 1, "B", 5.0), ("D2.T", 2, "A", 7.0)]
    assert rows(both.expression, "cell_type", "cell_id", "gene", "value") == want
    assert rows(both.cells, "cell_type", "cell_id", "reads") == [("D1.T", 1, 1.0), ("D1.T", 2, 2.0), ("D2.T", 1, 5.0), ("D2.T", 2, 7.0)]
    long = spark.createDataFrame([(d, "T", c, g, v) for d, c, g, v in entries], "dataset string, label string, cell string, gene string, value double")
    assert rows(tables.from_long(long).expression, "cell_type", "cell_id", "gene", "value") == want
    with pytest.raises(ValueError, match="`dataset`"):
        build(annotation, spark.createDataFrame([("c1", "A", 1.0)], "cell string, gene string, value double"))
    with pytest.raises(ValueError, match="more than once"):
        build(annotation.union(annotation.limit(1)), spark.createDataFrame(entries, "dataset string, cell string, gene string, value double"))


def test_specificity(a):
    assert dict(rows(specificity.cell_type_specificity(a, min_cells=1, min_fraction=0.3), "gene", "n_types")) == {"A": 1, "B": 3, "C": 2, "d": 0, "chr1_10_20": 0}
    assert dict(rows(specificity.tissue_specificity(a, min_cells=1), "gene", "n_datasets"))["A"] == 1
    assert rows(specificity.housekeeping(a, ["D1.T", "D1.U"], 0.4, 5), "gene") == [("B",), ("C",)]
    with pytest.raises(ValueError, match="max_genes"):
        specificity.housekeeping(a, ["D1.T", "D1.U"], 0.4)
    with pytest.raises(ValueError, match="no housekeeping"):
        specificity.housekeeping(a, ["D1.T", "D1.U"], 0.99, 5)
    with pytest.raises(ValueError, match="min_recall"):
        specificity.housekeeping(a, ["D1.T"], 1.0)
    with pytest.raises(ValueError, match="one dataset"):
        specificity.tissue_specificity(mini(a.spark, [("D2", "X")]))


def test_signature_is_the_greedy_prefix(a):
    got = rows(specificity.signature(a, ["d1.t", "D1.U"], min_cells=1, max_pval=1.0), "target", "position", "gene")
    assert got == [("D1.T", 1, "A"), ("D1.U", 1, "B")]


def test_signature_in_passes(a, monkeypatch):
    every = ["D1.T", "D1.U", "D2.X"]
    want = rows(specificity.signature(a, every, min_cells=1, max_pval=1.0), "target", "position", "gene")
    monkeypatch.setattr(specificity, "FIRST", 1)
    monkeypatch.setattr(specificity, "SENT", 0)
    assert rows(specificity.signature(a, every, min_cells=1, max_pval=1.0), "target", "position", "gene") == want


def test_similarity(a):
    got = {r.gene: (r.jaccard, r.overlap, r.n) for r in similarity.similar_genes(a, ["A"]).collect()}
    assert got["B"] == (pytest.approx(3 / 7), 3, 6) and "A" not in got
    assert [r.jaccard for r in similarity.similar_genes(a, ["A"], top_k=3).collect()] == sorted(r.jaccard for r in similarity.similar_genes(a, ["A"], top_k=3).collect())
    assert "A" in {r.gene for r in similarity.similar_genes(a, ["*A"]).collect()}


@pytest.mark.parametrize("cutoff", [1, 2, 3])
def test_mining_both_ways(a, cutoff):
    grown, counted = (rows(mining.frequent_sets(a, list("ABCd"), cutoff=cutoff, exhaustive=e), "query", "n_cells") for e in (False, True))
    assert grown == counted
    if cutoff == 1:
        assert dict(grown) == {"A,B": 3, "A,C": 2, "B,C": 3, "A,B,C": 1, "B,d": 1, "C,d": 1}


def test_all_sets(a):
    got = dict(rows(mining.frequent_sets(a, list("ABCd"), cutoff=0, exhaustive=True), "query", "n_cells"))
    assert len(got) == 11 and got["A,B"] == 3 and got["A,d"] == 0 and got["A,B,C,d"] == 0
    with pytest.raises(ValueError, match="32"):
        mining.frequent_sets(a, [f"g{i}" for i in range(33)], exhaustive=True)
    many = [f"g{i}" for i in range(28)] + list("ABCd")
    assert dict(rows(mining.frequent_sets(a, many, exhaustive=True), "query", "n_cells")) == {k: n for k, n in got.items() if n}


def test_recommended_queries(a):
    assert mining.recommended_queries(a, ["A"], ["D1"]).count() == mining.recommended_queries(a, ["A", "B"], []).count() == 0
    assert mining.recommended_queries(a, ["none", "no"], ["D1"]).count() == 0
    assert rows(mining.recommended_queries(a, ["a", "B"], ["D1"]), "query", "n_cells") == [("A,B", 2)]


def test_tfidf_and_ranking(a):
    w = {r.gene: r.tfidf for r in mining.tfidf(a, ["A", "B"]).collect()}
    assert w["A"] == pytest.approx((3 / 5 + 2 / 6 + 1 / 4 + 1 / 2) * 9 / 4)
    top = {r.query: r for r in mining.marker_genes(a, ["a", "b", "c"]).collect()}
    assert top["A,B"].tfidf == pytest.approx((w["A"] + w["B"]) * min(w.values())) and top["A,B"].n_cells == 3
    assert mining.marker_genes(a, ["none"]).count() == 0


def test_merge_is_build_of_the_union(spark, a):
    parts = merge(mini(spark, [("D1", "T"), ("D1", "U")]), mini(spark, [("D2", "X"), ("D1", "Z")]))
    assert rows(parts.expression, *parts.expression.columns) == rows(a.expression, *parts.expression.columns)
    with pytest.raises(ValueError, match="more than one"):
        merge(a, a)


def test_save_and_load(spark, a, tmp_path):
    path = str(tmp_path / "i")
    assert save(a, path) == 1
    b = load(spark, path)
    for t in ("expression", "cells", "cell_types", "support", "genes"):
        x, y = getattr(a, t), getattr(b, t)
        assert rows(x, *sorted(x.columns)) == rows(y, *sorted(x.columns))
    manifest = Manifest(spark, path)
    assert manifest.commit(2, {**manifest.read()[1], "version": 9})
    with pytest.raises(ValueError, match="version"):
        load(spark, path)
    with pytest.raises(ValueError, match="no index"):
        load(spark, str(tmp_path / "other"))


def test_wide_source(spark):
    w = spark.createDataFrame([("c1", "T", 1.0, 0.0), ("c2", "T", 0.0, 2.0)], "cell string, cell_type1 string, `g.1` double, g2 double")
    assert rows(tables.from_wide(w, "D").expression, "gene", "cell_id", "value") == [("g.1", 1, 1.0), ("g2", 2, 2.0)]
    with pytest.raises(ValueError, match="dot"):
        tables.from_wide(w, "D.1")


def test_dots_in_datasets_are_errors(spark):
    for name in ("D.1", "", None):
        with pytest.raises(ValueError, match="dataset"):
            build(spark.createDataFrame([(name, "T", "c1"), ("D", "T", "c2")], "dataset string, label string, cell string"), spark.createDataFrame([("c1", "A", 1.0)], "cell string, gene string, value double"))


def test_merge_of_a_wide_frame(spark, a):
    w = spark.createDataFrame([("c1", "T", 1.0), ("c2", "T", 2.0)], "cell string, cell_type1 string, A double")
    both = tables.merge_wide(a, w, "D3")
    assert both.datasets() == ["D1", "D2", "D3"] and boolean.find(both, ["A"]).count() == 6 and both.qb == a.qb


def test_numbering_of_string_keys_over_blocks(spark, monkeypatch):
    from postella.plans import atlas as module

    monkeypatch.setattr(module, "BLOCK_BITS", 2)
    keys = sorted({f"AAAC{chr(65 + i * 7 % 26)}{chr(65 + i * 5 % 26)}{'x' * (i % 3)}é{i % 2}" for i in range(90)} | {"AAAC", "AAACA"})
    df = spark.createDataFrame([("ab"[i % 2], k) for i, k in enumerate(keys)], "cell_type string, k string")
    blocks = [r.b for r in df.orderBy("k").select(module.key_block(df, "k").alias("b")).collect()]
    assert blocks == sorted(blocks) and len(set(blocks)) > 5
    got = rows(module.number_cells(df, "k"), "cell_type", "cell_id", "k")
    assert got == sorted((t, i + 1, k) for t in "ab" for i, k in enumerate(x for j, x in enumerate(keys) if "ab"[j % 2] == t))


def test_lists_in_blocks(a, monkeypatch):
    monkeypatch.setattr(lookup, "LIST_BITS", 1)
    assert rows(boolean.cells_by_type(boolean.find(a, ["A"])), "cell_type", "block", "cell_ids") == [("D1.T", 0, [1]), ("D1.T", 1, [2, 3]), ("D2.X", 0, [1])]
    assert rows(lookup.posting_lists(a).where("gene = 'C' and cell_type = 'D2.X'"), "n_cells", "cell_ids") == [(2, [2, 3])]


def test_posting_by_number(a):
    every = sorted({(r.gene, r.cell_type) for r in a.expression.collect()})
    for i in (0, len(every) - 1):
        assert {(r.gene, r.cell_type) for r in lookup.posting_at(a, i).collect()} == {every[i]}
    assert lookup.posting_at(a, len(every)).count() == lookup.posting_at(a, -1).count() == 0
    # counted name by name, as if there were very many
    assert [tuple(lookup.posting_key(a, i, most=1).first()) for i in range(len(every))] == every
    assert lookup.posting_key(a, len(every), most=1).count() == 0


def test_numbering_over_blocks(spark):
    from postella.plans.atlas import number_cells

    df = spark.createDataFrame([("a", i * 700_000) for i in range(9)] + [("b", 5)], "cell_type string, k long")
    assert rows(number_cells(df, "k"), "cell_type", "cell_id", "k") == [("a", i + 1, i * 700_000) for i in range(9)] + [("b", 1, 5)]


def test_codec(a):
    q = codec.dequantise(codec.quantise(a, 6), 6)
    many = q.where("sigma > 0").select(F.max(F.abs(F.log1p("decoded") - F.log1p("value"))).alias("d")).first().d
    assert many < 0.4
    m = {r.gene: r.asDict() for r in codec.cell_type_matrix(a, "D2.X").collect()}
    assert m["C"] == {"gene": "C", "1": 0.0, "2": 2.0, "3": 2.0, "4": 0.0} and set(m) == {"A", "B", "C", "d"}
    with pytest.raises(ValueError, match="bits"):
        codec.quantise(a, 40)
    assert {(r.gene, r.cell_block): r["values"] for r in codec.cell_type_vectors(a, "D2.X").collect()}["C", 0] == [0.0, 2.0, 2.0, 0.0]


def test_tiles(a, monkeypatch):
    whole = rows(codec.cell_type_expression(a, "D2.X"), "gene", "cell_id", "value")
    assert len(whole) == 16 and ("d", 2, 1.0) in whole and ("A", 4, 0.0) in whole
    monkeypatch.setattr(codec, "TILE_GENES", 3)
    monkeypatch.setattr(codec, "TILE_CELLS", 3)
    tiles = {(r.gene_block, r.cell_block): r for r in codec.cell_type_tiles(a, "D2.X").collect()}
    assert set(tiles) == {(0, 0), (0, 1), (1, 0), (1, 1)} and tiles[1, 0].genes == ["d"] and tiles[0, 1].n_cells == 1 and tiles[1, 1].value == []
    assert (tiles[0, 0].row, tiles[0, 0].column, tiles[0, 0].value) == ([0, 1, 1, 2, 2], [0, 0, 2, 1, 2], [1.0, 1.0, 1.0, 2.0, 2.0])
    assert rows(codec.cell_type_expression(a, "D2.X"), "gene", "cell_id", "value") == whole
    assert {(r.gene, r.cell_block): r["values"] for r in codec.cell_type_vectors(a, "D2.X").collect()}["C", 0] == [0.0, 2.0, 2.0]
    assert {r.gene: r.asDict() for r in codec.cell_type_matrix(a, "D2.X").collect()}["C"] == {"gene": "C", "1": 0.0, "2": 2.0, "3": 2.0, "4": 0.0}
    monkeypatch.setattr(codec, "WIDE", 3)
    with pytest.raises(ValueError, match="tiles"):
        codec.cell_type_matrix(a, "D2.X")
    assert codec.cell_type_expression(a, "no such").count() == 0


def test_tiles_of_a_very_large_type(spark):
    """A million cells: no row holds more than a tile."""
    n = 1_000_000
    ids = spark.range(n)
    annotation = ids.selectExpr("'D' dataset", "'T' label", "id cell")
    entries = ids.selectExpr("'D' dataset", "id cell", "explode(array('a', if(id % 3 = 0, 'b', 'c'))) gene", "cast(id % 7 + 1 as double) value")
    t = codec.cell_type_tiles(build(annotation, entries), "D.T")
    got = t.select(F.count("*"), F.max(F.size("value")), F.sum("n_cells"), F.sum(F.size("value")), F.sum(F.aggregate("value", F.lit(0.0), lambda x, v: x + v))).first()
    assert tuple(got) == (489, 2 * codec.TILE_CELLS, n, 2 * n, 2.0 * sum(i % 7 + 1 for i in range(n)))


def test_older_codec_by_hand(spark):
    """Codes and values worked out from the definition with math.erfc: the next cell's value, the last cell's deviation, the wrap."""
    values = [3.0, 0.0, 1.0, 8.0, 2.0]
    cells = [("D", "T", f"c{i}") for i in range(5)]
    entries = [("D", f"c{i}", "g", v) for i, v in enumerate(values) if v]
    one = build(spark.createDataFrame(cells, "dataset string, label string, cell string"), spark.createDataFrame(entries, "dataset string, cell string, gene string, value double"))
    logs = [math.log(v + 1) for v in values if v]
    mu, n = sum(logs) / 4, 4
    sigma = abs(mu - logs[-1]) / math.sqrt(n)
    follows = [math.log(v + 1) for v in (0.0, 8.0, 2.0, 0.0)]
    want = [int(math.floor((1 - 0.5 * math.erfc((x - mu) / (sigma * math.sqrt(0.5)))) * 4 + 0.5)) % 4 for x in follows]
    got = codec.dequantise(codec.quantise(one, 2, "compat"), 2, "compat").orderBy("cell_id").collect()
    assert [r.cell_id for r in got] == [1, 3, 4, 5] and [r.code for r in got] == want and got[0].sigma == pytest.approx(sigma)
    bins = {0: 1, 1: 3, 2: 3, 3: 2}
    from statistics import NormalDist

    for r in got:
        assert math.log(r.decoded) == pytest.approx(NormalDist(mu, sigma).inv_cdf((bins[r.code] + 0.5) / 4), abs=5e-3 * sigma)
    assert {r.decoded for r in codec.dequantise(codec.quantise(one, 1, "compat"), 1, "compat").where("code = 1").collect()} <= {None}
    with pytest.raises(ValueError, match="codec"):
        codec.quantise(one, codec="other")


def test_intervals(spark):
    peaks = spark.createDataFrame([("chr1_10_20",), ("chr1_15_400",), ("chr2_10_20",)], "gene string")
    assert intervals.all_peaks(peaks)
    assert intervals.loci(peaks.union(spark.createDataFrame([("Gata4",)], "gene string")), "chr1:5-100").count() == 0
    got = intervals.loci(peaks, "CHR1:5-100, chr1_5_100 chr2:9-3").collect()
    assert [(r.input, r.gene, r.gap_before, r.width, r.gap_after) for r in got] == [("chr1:5-100", "chr1_10_20", 5, 10, 80)]
    assert peaks.select(locus_name(F.col("gene")).alias("x")).first().x == "chr1:10-20"
    assert spark.createDataFrame([("chr1:10-20",)], "x string").select(peak_name(F.col("x")).alias("y")).first().y == "chr1_10_20"


def test_intervals_over_bins(spark, monkeypatch):
    """Regions and peaks that span bins, against all pairs."""
    import random

    rng = random.Random(5)
    peaks = [(f"chr{rng.randrange(3)}", s := rng.randrange(1 << 22), s + rng.choice([1, 50, 20_000, 300_000])) for _ in range(400)]
    asked = [(f"r{i}", f"chr{rng.randrange(4)}", s := rng.randrange(1 << 22), s + rng.choice([0, 10, 5_000, 70_000, 1 << 20, 1 << 40])) for i in range(60)]
    df = spark.createDataFrame([(f"{c}_{s}_{e}",) for c, s, e in peaks], "gene string")
    regions = spark.createDataFrame([*asked, ("null", None, None, None)], "input string, q_chromosome string, q_start long, q_end long")
    want = sorted((r, f"{c}_{s}_{e}") for r, q, lo, hi in asked for c, s, e in peaks if c == q and s >= lo and e <= hi)
    assert len(want) > 100 and rows(intervals.peaks_in(df, regions), "input", "gene") == want
    assert intervals.peaks_in(df, regions.limit(0)).count() == intervals.peaks_in(df.limit(0), regions).count() == 0
    plan = intervals.peaks_in(df, regions)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_pairs_of_intervals_are_dealt_to_tasks(spark, monkeypatch):
    """One file of peaks and one of regions, all in a few bins, make far more pairs than rows: no task has them all, nothing is broadcast."""
    monkeypatch.setattr(intervals, "TASK_PAIRS", 1 << 14, raising=False)
    monkeypatch.setattr(intervals, "TILE_BITS", 4, raising=False)
    peaks = spark.range(400).coalesce(1).select(F.format_string("chr1_%d_%d", F.col("id") * 10, F.col("id") * 10 + 5).alias("gene"))
    asked = spark.range(400).coalesce(1).select(F.format_string("r%d", "id").alias("input"), F.lit("chr1").alias("q_chromosome"), F.col("id").alias("q_start"), (F.col("id") * 9 + 1000).alias("q_end"))
    found = intervals.peaks_in(peaks, asked)
    want = sorted((f"r{i}", f"chr1_{s}_{s + 5}") for i in range(400) for s in range(0, 4000, 10) if s >= i and s + 5 <= i * 9 + 1000)
    assert rows(found, "input", "gene") == want
    dealt = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(dealt) > 4 and max(dealt) < len(want) / 3
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    backward = spark.createDataFrame([("chr1_250_150",)], "gene string")
    assert rows(intervals.peaks_in(backward, spark.createDataFrame([("r", "chr1", 100, 200)], asked.schema)), "input", "gene") == [("r", "chr1_250_150")]


def test_display(spark, a):
    umap = a.cells.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    assert sum(r.hit for r in display.umap_hits(umap, boolean.find(a, ["A", "B"]), ["D1.T"]).collect()) == 2
    got = spark.createDataFrame([(123456.789,), (0.00012345,), (0.0,)], "x double").select(display.signif(F.col("x"), 3).alias("y")).collect()
    assert [r.y for r in got] == pytest.approx([123000.0, 0.000123, 0.0])
    assert display.fold_markers(markers.score(a, ["D1.U"], genes=["B", "d"])).first().markers.startswith("B : ")


def test_streaming_growth(spark, tmp_path):
    from postella.streaming.ingest import grow

    rows_ = [(d, lab, c, g, float(v)) for (d, lab), cs in CELLS.items() for c, gs in cs for g, v in (gs or {None: 0}).items()]
    spark.createDataFrame(rows_, "dataset string, label string, cell string, gene string, value double").write.parquet(str(tmp_path / "in"))
    schema = "dataset string, label string, cell string, gene string, value double"
    q = grow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert load(spark, str(tmp_path / "out")).cells.count() == 9
    assert Manifest(spark, str(tmp_path / "out")).read()[1]["parts"] == ["batch-0000000000"]


def test_places_of_a_long_ordered_result(spark):
    # more rows than any limit on the way, in several parts; empty results have no places
    many = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("x")).orderBy("x")
    assert sorted((r.position, r.x) for r in display.in_order(many).collect()) == [(i + 1, i) for i in range(5000)]
    assert display.in_order(many.where("x < 0")).count() == 0


def test_genes_of_a_frame_are_evaluated_like_a_list(spark, a):
    asked = ["a", "B", "C"]
    frame = spark.createDataFrame([(g,) for g in [*asked, "none"]], "gene string")
    want = markers.evaluate(a, asked, ["D1.T", "D1.U"], sort_field="recall").collect()
    assert want and markers.evaluate(a, frame, ["D1.T", "D1.U"], sort_field="recall").collect() == want
