"""Queries over the driver's tables, one for each operation of the index, and the same in DuckDB SQL.

The SQL spells set algebra out literally (INTERSECT, UNION, EXCEPT, one conjunction for each prefix), so it
doesn't share its logic with the plans that it is held against.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.numeric import ERF, ERF_P, WINITZKI
from .operators import boolean, codec, display, enrichment, intervals, lookup, markers, mining, similarity, specificity
from .plans.atlas import Atlas, merge
from .sources import tables
from .sources.shared import shared_folder

_atlases: dict[tuple[str, str, str], Atlas] = {}


def atlas(spark: SparkSession, sf_dir: str, kind: str = "orders") -> Atlas:
    """The index over the tables, built and kept once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _atlases:
        _atlases[key] = tables.driver_atlas(spark, sf_dir, kind).persist()
    return _atlases[key]


B = [f"Brand#{i}" for i in range(26)]
MIXED = [B[1], f"*{B[2]}", f"*{B[3]}", f"-{B[4]}", f"*-{B[5]}", f"*-{B[6]}"]
EIGHT = [B[i] for i in (1, 2, 3, 4, 5, 8, 9, 19)]
TYPE, TYPES = "ASIA.NATION_2", ["ASIA.NATION_2", "EUROPE.NATION_3", "AFRICA.NATION_5"]
ROUND = 6

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_functions: dict[str, tuple[Callable[[Atlas], DataFrame], str]] = {}
_oracle: dict[str, str] = {}


def query(sql: str | None = None, kind: str = "orders"):
    """Register a query over an atlas; sql may name the tables ann, types, cells, e and sup."""

    def add(f):
        _functions[f.__name__] = f, kind
        _queries[f.__name__] = lambda spark, sf_dir: f(atlas(spark, sf_dir, kind))
        if sql:
            _oracle[f.__name__] = f"{_tables(kind)} {sql}"
        return f

    return add


def _tables(kind: str) -> str:
    """The index's tables as common table expressions."""
    place = "JOIN nation ON {n} = n_nationkey JOIN region ON n_regionkey = r_regionkey"
    head = "SELECT r_name AS dataset, n_name AS label, r_name || '.' || n_name AS cell_type, {k} AS k FROM "
    if kind == "orders":
        ann = head.format(k="o_orderkey") + "orders JOIN customer ON o_custkey = c_custkey " + place.format(n="c_nationkey")
        val = "SELECT l_orderkey AS k, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"
    elif kind == "barcodes":
        # cells of several datasets share names, so a key is both
        bought = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey " + place.format(n="c_nationkey") + " JOIN part ON l_partkey = p_partkey"
        key = "r_name || ':' || lpad(l_partkey::VARCHAR, 12, '0') AS k"
        ann = f"SELECT DISTINCT r_name AS dataset, p_brand AS label, r_name || '.' || p_brand AS cell_type, {key} FROM {bought}"
        val = f"SELECT {key}, s.n_name AS gene, sum(l_quantity) AS value FROM {bought} JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY 1, 2"
    elif kind in ("customer", "classes"):
        ann = head.format(k="c_custkey") + "customer " + place.format(n="c_nationkey")
        gene = "p_brand" if kind == "customer" else "'class' || p_size % 8"
        val = f"SELECT o_custkey AS k, {gene} AS gene, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"
    else:
        ann = head.format(k="s_suppkey") + "supplier " + place.format(n="s_nationkey")
        gene = "p_type" if kind == "supplier" else "'P' || p_partkey"
        val = f"SELECT l_suppkey AS k, {gene} AS gene, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"
    return f"""WITH ann AS ({ann}),
types AS (SELECT cell_type, any_value(dataset) AS dataset, any_value(label) AS label, count(*) AS total_cells FROM ann GROUP BY 1 HAVING count(*) >= 2),
numbered AS (SELECT a.dataset, a.cell_type, a.k, row_number() OVER (PARTITION BY a.cell_type ORDER BY a.k) AS cell_id FROM ann a JOIN types USING (cell_type)),
val AS ({val} HAVING sum(l_quantity) > 0),
e AS (SELECT n.dataset, n.cell_type, n.cell_id, v.gene, v.value FROM numbered n JOIN val v USING (k)),
cells AS (SELECT n.dataset, n.cell_type, n.cell_id, coalesce(sum(v.value), 0.0) AS reads, count(v.gene) AS features FROM numbered n LEFT JOIN val v USING (k) GROUP BY 1, 2, 3),
sup AS (SELECT gene, cell_type, dataset, count(*) AS n_cells FROM e GROUP BY 1, 2, 3)"""


def _in(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _has(genes: list[str], where: str = "true") -> str:
    """Cells that have all genes, as an intersection of postings."""
    return "(" + " INTERSECT ".join(f"SELECT dataset, cell_type, cell_id FROM e WHERE gene = '{g}' AND {where}" for g in genes) + ")"


_AND = _has(B[1:3])
_MIXED = f"(({_has([B[1], B[2]])} UNION {_has([B[1], B[3]])}) EXCEPT ({_has([B[4], B[5]])} UNION {_has([B[4], B[6]])}))"
_ALL = "(SELECT dataset, cell_type, cell_id FROM cells)"


# lookups and counts


@query("SELECT DISTINCT gene FROM e ORDER BY gene")
def genes_list(a):
    return lookup.gene_names(a)


@query("SELECT cell_type, dataset, label FROM types")
def cell_type_names(a):
    return lookup.cell_type_names(a)


@query("SELECT cell_type, dataset, label FROM types WHERE dataset IN ('ASIA', 'EUROPE')")
def cell_type_names_ds(a):
    return lookup.cell_type_names(a, ["ASIA", "EUROPE"])


@query("SELECT * FROM (VALUES (1::BIGINT, 'Brand#2'), (2::BIGINT, 'Brand#1')) t(position, gene)")
def case_correct(a):
    return lookup.case_correct(a, ["bRAND#2", "BRAND#1", "Brand#2", "Brand#99"]).selectExpr("row_number() over (order by position) position", "gene").selectExpr("cast(position as bigint) position", "gene")


@query(f"SELECT dataset, cell_type, cell_id, gene, value FROM e WHERE gene IN ({_in(B[1:3])}) AND dataset IN ('ASIA')")
def query_genes_or(a):
    return lookup.query_genes(a, B[1:3], ["ASIA"])


@query(f"SELECT cell_id, value FROM e WHERE gene = 'Brand#1' AND cell_type = '{TYPE}'")
def posting_entry(a):
    return lookup.entry_of(a, B[1], TYPE)


@query("SELECT dataset, cell_type, cell_id, reads, features FROM cells")
def cell_meta(a):
    return lookup.cell_meta(a)


@query("SELECT cell_type, dataset, label, total_cells FROM types")
def cell_type_meta(a):
    return a.cell_types


@query("SELECT t.cell_type, t.cell_type IN (SELECT cell_type FROM types) AS known FROM (VALUES ('ASIA.NATION_2'), ('EUROPE.ATLANTIS')) t(cell_type)")
def known_cell_types(a):
    return lookup.known_types(a, ["ASIA.NATION_2", "EUROPE.ATLANTIS", "ASIA.NATION_2"])


@query("SELECT t.gene, coalesce(s.n, 0)::BIGINT AS n_cells FROM (VALUES ('Brand#1'), ('Brand#2'), ('Brand#99')) t(gene) LEFT JOIN (SELECT gene, sum(n_cells) AS n FROM sup WHERE dataset IN ('ASIA', 'AFRICA') GROUP BY 1) s USING (gene)")
def gene_support(a):
    return lookup.gene_support(a, [B[1], B[2], "Brand#99"], ["ASIA", "AFRICA"])


@query(f"SELECT gene, cell_type, n_cells FROM sup WHERE gene IN ({_in(B[1:4])})")
def gene_support_ct(a):
    return lookup.gene_support_by_type(a, B[1:4])


@query("SELECT DISTINCT gene FROM e WHERE gene NOT IN (SELECT gene FROM e WHERE dataset = (SELECT min(dataset) FROM types))", "supplier")
def zero_support_genes(a):
    return lookup.zero_support_genes(a, a.datasets()[:1])


@query("SELECT count(DISTINCT gene) AS n_genes FROM e WHERE gene NOT IN (SELECT gene FROM e WHERE dataset = (SELECT min(dataset) FROM types))", "parts")
def zero_support_count(a):
    return lookup.zero_support_count(a, a.datasets()[:1])


@query("SELECT DISTINCT gene FROM e WHERE gene NOT IN (SELECT gene FROM e WHERE dataset = (SELECT min(dataset) FROM types))", "parts")
def zero_support_parts(a):
    return lookup.zero_support_genes(a, a.datasets()[:1])


@query("SELECT gene, cell_type, cell_id, value FROM e JOIN (SELECT gene, cell_type FROM sup ORDER BY gene, cell_type LIMIT 1 OFFSET 7) USING (gene, cell_type)")
def decode_posting(a):
    return lookup.posting_at(a, 7)


def _nth_postings(a: Atlas, at: list[int]) -> DataFrame:
    """Postings by their place, with the place that was asked."""
    found = [lookup.posting_at(a, i).withColumn("i", F.lit(i)) for i in at]
    return reduce(DataFrame.unionByName, found)


@query("""SELECT i, gene, cell_type, cell_id, value FROM e JOIN (SELECT gene, cell_type, (row_number() OVER (ORDER BY gene, cell_type) - 1)::INT AS i FROM sup) USING (gene, cell_type) WHERE i IN (0, 312, 624, 625, 9000)""")
def decode_postings(a):
    return _nth_postings(a, [0, 312, 624, 625, 9000, -1])


@query("SELECT i, gene, cell_type FROM (SELECT gene, cell_type, (row_number() OVER (ORDER BY gene, cell_type) - 1)::INT AS i FROM sup) WHERE i IN (0, 7, 100, 801, 999999999)", "parts")
def decode_posting_names(a):
    """Of an index of very many postings, which are told by their names in parts."""
    found = [lookup.posting_key(a, i, most=100).withColumn("i", F.lit(i)) for i in (0, 7, 100, 801, 999999999)]
    return reduce(DataFrame.unionByName, found)


@query("SELECT (SELECT sum(total_cells) FROM types)::BIGINT AS n_cells, (SELECT count(DISTINCT gene) FROM e) AS n_genes, (SELECT count(*) FROM sup) AS n_postings")
def index_size(a):
    return lookup.cells_in_index(a)


@query("SELECT dataset, count(*) AS n_cell_types, sum(total_cells)::BIGINT AS total_cells FROM types WHERE dataset IN ('ASIA', 'EUROPE') GROUP BY 1")
def selected_datasets(a):
    return a.cell_types.where(F.col("dataset").isin(lookup.select_datasets(a, ["ASIA", "EUROPE"]))).groupBy("dataset").agg(F.count("*").alias("n_cell_types"), F.sum("total_cells").alias("total_cells"))


@query("SELECT sum(total_cells)::BIGINT AS total_cells, count(*) AS n_cell_types FROM types WHERE dataset IN ('ASIA', 'EUROPE')")
def total_cells(a):
    return lookup.total_cells(a, ["ASIA", "EUROPE"])


@query("SELECT sum(total_cells)::BIGINT AS total_cells, count(*) AS n_cell_types FROM types")
def n_cell_types(a):
    return lookup.total_cells(a)


@query("SELECT t.position, t.cell_type, coalesce(total_cells, 0)::BIGINT AS total_cells FROM (VALUES (1::BIGINT, 'ASIA.NATION_2'), (2::BIGINT, 'X.Y'), (3::BIGINT, 'AFRICA.NATION_5'), (4::BIGINT, 'ASIA.NATION_2')) t(position, cell_type) LEFT JOIN types USING (cell_type)")
def cell_type_support(a):
    return lookup.cell_type_support(a, ["ASIA.NATION_2", "X.Y", "AFRICA.NATION_5", "ASIA.NATION_2"])


@query("SELECT gene, cell_type, n_cells, c.ids AS cell_ids FROM sup JOIN (SELECT gene, cell_type, string_agg(cell_id::VARCHAR, ',' ORDER BY cell_id) AS ids FROM e GROUP BY 1, 2) c USING (gene, cell_type)")
def postings(a):
    return lookup.posting_lists(a).select("gene", "cell_type", "n_cells", F.array_join("cell_ids", ",").alias("cell_ids"))


@query(f"SELECT gene, cell_type, round(log2(total_cells / n_cells), {ROUND}) AS idf FROM sup JOIN types USING (cell_type)")
def idf(a):
    return lookup.posting_lists(a).select("gene", "cell_type", F.round("idf", ROUND).alias("idf"))


@query("""SELECT count(*) AS postings, sum(h + low + q + 32)::BIGINT AS bytes FROM (SELECT floor((floor(last / power(2, l))::BIGINT + n) / 8) + 1 AS h, floor(l * n / 8) + 1 AS low, floor(n * 2 / 8) + 12 AS q
FROM (SELECT n, last, floor(log2(total_cells / n) + 0.5) + 1 AS l FROM (SELECT gene, cell_type, count(*) AS n, max(cell_id) AS last FROM e GROUP BY 1, 2) p JOIN types USING (cell_type)))""")
def memory_footprint(a):
    return lookup.memory_footprint(a)


# boolean queries


@query(f"SELECT * FROM {_AND}")
def and_query(a):
    return boolean.find(a, B[1:3])


@query(f"SELECT DISTINCT dataset, cell_type, cell_id FROM e WHERE gene IN ({_in(B[1:4])})")
def or_query(a):
    return boolean.find(a, [f"*{g}" for g in B[1:4]])


@query(f"SELECT * FROM ({_has([B[1]])} EXCEPT {_has(B[2:4])})")
def not_query(a):
    return boolean.find(a, [B[1], f"-{B[2]}", f"-{B[3]}"])


@query(f"SELECT * FROM ({_has([B[1]])} EXCEPT ({_has([B[2]])} UNION {_has([B[3]])}))")
def not_or_query(a):
    return boolean.find(a, [B[1], f"*-{B[2]}", f"-*{B[3]}"])


@query(f"SELECT * FROM {_MIXED}")
def mixed_query(a):
    return boolean.find(a, MIXED)


@query(f"SELECT * FROM ({_ALL} EXCEPT {_has(B[1:3])})")
def complement_query(a):
    return boolean.find(a, [f"-{B[1]}", f"-{B[2]}", "Brand#99"])


@query(f"SELECT * FROM {_has(B[1:3], chr(34) + 'dataset' + chr(34) + ' IN (' + _in(['ASIA', 'EUROPE']) + ')')}")
def dataset_scoped_query(a):
    return boolean.find(a, B[1:3], ["ASIA", "EUROPE"])


@query(f"SELECT cell_type, string_agg(cell_id::VARCHAR, ',' ORDER BY cell_id) AS cell_ids FROM {_AND} GROUP BY 1")
def query_cells_by_type(a):
    return boolean.cells_by_type(boolean.find(a, B[1:3])).select("cell_type", F.array_join("cell_ids", ",").alias("cell_ids"))


@query(f"SELECT cell_type, count(*) AS n_cells FROM {_AND} GROUP BY 1")
def contingency_table(a):
    return boolean.contingency_table(boolean.find(a, B[1:3]))


# enrichment


def _hyper(hits: str, scope: str = "true") -> str:
    """The tail summed term by term over lgamma, then Holm's adjustment."""
    lc = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
    return f"""SELECT cell_type, cell_hits, total_cells, round(least(1.0, max((n - i + 1) * p) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)), {ROUND}) AS pval FROM (
SELECT *, row_number() OVER (ORDER BY p) AS i FROM (SELECT cell_type, x AS cell_hits, m AS total_cells, n, 1 - (1 - coalesce(list_sum(list_transform(CASE WHEN x + 1 <= least(k, m) THEN range(x + 1, least(k, m) + 1) ELSE [] END, lambda j: CASE WHEN k - j <= u - m THEN exp({lc('m', 'j')} + {lc('(u - m)', '(k - j)')} - {lc('u', 'k')}) ELSE 0 END)), 0)) AS p FROM (
SELECT h.cell_type, x, total_cells AS m, (sum(x) OVER ())::BIGINT AS k, (sum(total_cells) OVER ())::BIGINT AS u, (SELECT count(*) FROM types WHERE {scope}) AS n FROM (SELECT cell_type, count(*) AS x FROM {hits} GROUP BY 1) h JOIN types USING (cell_type))))"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, ROUND) for c in columns})


@query(_hyper(_AND))
def hyper_query(a):
    return _rounded(enrichment.hyper_query(a, B[1:3]), "pval")


@query(_hyper(_has(B[1:3], "dataset = 'ASIA'"), "dataset = 'ASIA'"))
def hyper_query_holm(a):
    return _rounded(enrichment.hyper_query(a, B[1:3], ["ASIA"]), "pval")


@query(_hyper(_MIXED))
def hyper_query_not(a):
    return _rounded(enrichment.hyper_query(a, MIXED), "pval")


@query(f"SELECT cell_type, round(-log10(pval), {ROUND}) AS score FROM ({_hyper(_has(['Brand#1']))}) WHERE pval > 0")
def neg_log10_pval(a):
    return _rounded(enrichment.hyper_query(a, [B[1]]), "pval").where("pval > 0").select("cell_type", F.round(display.neg_log10(F.col("pval")), ROUND).alias("score"))


# markers


def _metrics(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    """By way of the inverses, as doubles divide: what is over 0 is infinite, 0 over 0 isn't a number and stands as null."""
    inverse = lambda x: f"CASE WHEN {tp} <> 0 THEN ({tp} + {x}) / {tp} WHEN {x} <> 0 THEN 'inf'::DOUBLE END"
    over = lambda x, y: f"CASE WHEN {x} = 0 THEN 'inf'::DOUBLE WHEN isinf({x}) THEN 0.0 ELSE {y} / {x} END"
    return f"round({over(f'({inverse(fp)})', '1.0')}, {ROUND}) AS precision, round({over(f'({inverse(fn)})', '1.0')}, {ROUND}) AS recall, round({over(f'(({inverse(fp)}) + ({inverse(fn)}))', '2.0')}, {ROUND}) AS f1"


def _scores(targets: list[str], background: str = "true", where: str = "true") -> str:
    return f"""SELECT cell_type, gene, tp, fp, fn, {_metrics()} FROM (
SELECT s.cell_type, s.gene, s.n_cells AS tp, (coalesce(b.n, 0) - s.n_cells)::BIGINT AS fp, total_cells - s.n_cells AS fn FROM sup s JOIN types t USING (cell_type) LEFT JOIN (SELECT gene, sum(n_cells) AS n FROM sup WHERE {background} GROUP BY 1) b USING (gene) WHERE s.cell_type IN ({_in(targets)}) AND {where})"""


_METRICS = ("precision", "recall", "f1")


@query(f"SELECT * FROM ({_scores(TYPES)}) ORDER BY f1 DESC, list_position([{_in(TYPES)}], cell_type), gene LIMIT 5")
def markers_topk(a):
    return _rounded(markers.top_markers(a, TYPES), *_METRICS)


@query(_scores([TYPE], f"cell_type IN ({_in(['ASIA.NATION_7', 'ASIA.NATION_12'])})"))
def markers_background(a):
    return _rounded(markers.score(a, [TYPE], ["ASIA.NATION_7", "ASIA.NATION_12"]), *_METRICS)


@query(f"SELECT * FROM ({_scores(TYPES)}) ORDER BY recall DESC, list_position([{_in(TYPES)}], cell_type), gene LIMIT 10")
def markers_by_recall(a):
    return _rounded(markers.top_markers(a, TYPES, top_k=10, sort_field="recall"), *_METRICS)


@query(f"SELECT row_number() OVER (ORDER BY f1 DESC, list_position([{_in(TYPES)}], cell_type), gene) AS position, cell_type, gene FROM ({_scores(TYPES)}) ORDER BY 1 LIMIT 12")
def markers_topk_in_order(a):
    return display.in_order(markers.top_markers(a, TYPES, top_k=12)).select("position", "cell_type", "gene")


@query(f"SELECT row_number() OVER (ORDER BY fn, list_position([{_in(TYPES)}], cell_type), gene) AS position, cell_type, gene FROM ({_scores(TYPES, where=f's.gene IN ({_in(B[1:9])})')})")
def evaluate_markers_in_order(a):
    return display.in_order(markers.evaluate(a, B[1:9], TYPES, sort_field="fn")).select("position", "cell_type", "gene")


#: Single parts come from few suppliers, so most of a type's aren't in its neighbour's.
_EXCLUSIVE = _scores([TYPE], "cell_type = 'ASIA.NATION_7'")


@query(f"SELECT row_number() OVER (ORDER BY f1 DESC NULLS LAST, gene) AS position, gene, tp, fp, fn, isinf(precision) AS nothing_false, f1 FROM ({_EXCLUSIVE}) ORDER BY 1 LIMIT 50", "parts")
def markers_exclusive(a):
    top = markers.top_markers(a, [TYPE], ["ASIA.NATION_7"], top_k=50)
    return _rounded(display.in_order(top), "f1").select("position", "gene", "tp", "fp", "fn", (F.col("precision") == float("inf")).alias("nothing_false"), "f1")


@query(f"SELECT row_number() OVER (ORDER BY precision NULLS LAST, gene) AS position, gene FROM ({_EXCLUSIVE}) WHERE gene < 'P12'", "parts")
def evaluate_exclusive_in_order(a):
    return display.in_order(markers.evaluate(a, a.genes.where("gene < 'P12'").select("gene"), [TYPE], ["ASIA.NATION_7"], "precision")).select("position", "gene")


@query(_scores(TYPES, where=f"s.gene IN ({_in(B[1:4])})"))
def evaluate_markers(a):
    return _rounded(markers.evaluate(a, ["brand#1", *B[2:4]], TYPES), *_METRICS)


@query(f"""SELECT cell_type, gene, tp, fp, fn, {_metrics()} FROM (
SELECT t.cell_type, 'Brand#1,Brand#2,' AS gene, coalesce(n, 0) AS tp, ((SELECT count(*) FROM {_AND}) - coalesce(n, 0))::BIGINT AS fp, CASE WHEN n IS NULL THEN 0 ELSE total_cells - n END AS fn FROM types t LEFT JOIN (SELECT cell_type, count(*) AS n FROM {_AND} GROUP BY 1) h USING (cell_type) WHERE t.cell_type IN ({_in(TYPES)}))""")
def evaluate_markers_and(a):
    return _rounded(markers.evaluate_all(a, B[1:3], TYPES), *_METRICS)


@query(f"SELECT cell_type, string_agg(gene || ' : ' || printf('%.3f', f1), ', ' ORDER BY gene) AS markers FROM ({_scores(TYPES, where=f's.gene IN ({_in(B[1:6])})')}) GROUP BY 1")
def marker_string_agg(a):
    return display.fold_markers(_rounded(markers.score(a, TYPES, genes=B[1:6]), *_METRICS))


# specificity


@query("SELECT g.gene, count(s.gene) AS n_types FROM (SELECT DISTINCT gene FROM e) g LEFT JOIN (SELECT s.gene FROM sup s JOIN types USING (cell_type) WHERE s.n_cells > greatest(10, total_cells * 0.155)) s ON g.gene = s.gene GROUP BY 1")
def ct_specificity(a):
    return specificity.cell_type_specificity(a, min_fraction=0.155)


@query("SELECT g.gene, count(s.gene) AS n_datasets FROM (SELECT DISTINCT gene FROM e) g LEFT JOIN (SELECT gene FROM sup GROUP BY dataset, gene HAVING sum(n_cells) > 440) s ON g.gene = s.gene GROUP BY 1")
def tissue_specificity(a):
    return specificity.tissue_specificity(a, min_cells=440)


@query(f"""SELECT gene FROM (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY n_cells / total_cells DESC, gene) AS i FROM sup JOIN types USING (cell_type) WHERE cell_type IN ({_in(TYPES)}))
WHERE i <= 20 AND n_cells / total_cells > 0.5 GROUP BY gene HAVING count(*) = {len(TYPES)}""", "customer")
def housekeeping(a):
    return specificity.housekeeping(a, TYPES, max_genes=20)


def _signature(types: str, max_genes: int, min_cells: int, max_pval: float) -> str:
    """Each prefix of a type's list as a conjunction of its own: the cells that have as many of its genes as it has, their
    types' tails over lgamma, Holm's adjustment among them, and the lists up to the first prefix that fails."""
    lc = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
    return f"""SELECT target, position, gene FROM (SELECT *, max(bad::INT) OVER (PARTITION BY target ORDER BY position) AS stop FROM (
SELECT r.target, r.position, r.gene, EXISTS (SELECT 1 FROM judged j WHERE j.target = r.target AND j.position = r.position) AND coalesce((SELECT j.pval > {max_pval} OR j.x < greatest({min_cells}, j.m) FROM judged j WHERE j.target = r.target AND j.position = r.position AND j.cell_type = r.target), true) AS bad
FROM ranked r)) WHERE stop = 0""", f""", ranked AS (SELECT cell_type AS target, gene, row_number() OVER (PARTITION BY cell_type ORDER BY n_cells / total_cells DESC, gene)::INT AS position FROM sup JOIN types USING (cell_type) WHERE {types} QUALIFY position <= {max_genes}),
prefix_hits AS (SELECT target, position, cell_type, count(*) AS x FROM (SELECT p.target, p.position, e.cell_type, e.cell_id FROM ranked p JOIN ranked r ON r.target = p.target AND r.position <= p.position JOIN e ON e.gene = r.gene GROUP BY 1, 2, 3, 4 HAVING count(*) = p.position) GROUP BY 1, 2, 3),
tails AS (SELECT *, 1 - (1 - coalesce(list_sum(list_transform(CASE WHEN x + 1 <= least(k, m) THEN range(x + 1, least(k, m) + 1) ELSE [] END, lambda j: CASE WHEN k - j <= u - m THEN exp({lc('m', 'j')} + {lc('(u - m)', '(k - j)')} - {lc('u', 'k')}) ELSE 0 END)), 0)) AS p FROM (
SELECT target, position, h.cell_type, x, total_cells AS m, (sum(x) OVER (PARTITION BY target, position))::BIGINT AS k, (sum(total_cells) OVER (PARTITION BY target, position))::BIGINT AS u FROM prefix_hits h JOIN types t ON h.cell_type = t.cell_type)),
judged AS (SELECT target, position, cell_type, x, m, least(1.0, max(((SELECT count(*) FROM types) - i + 1) * p) OVER (PARTITION BY target, position ORDER BY i ROWS UNBOUNDED PRECEDING)) AS pval FROM (SELECT *, row_number() OVER (PARTITION BY target, position ORDER BY p) AS i FROM tails))"""


def _signature_query(name: str, kind: str, types: list[str] | None, *how) -> None:
    sql, tables_ = _signature(f"cell_type IN ({_in(types)})" if types else "true", *how)
    f = lambda a: specificity.signature(a, types or [r.cell_type for r in a.cell_types.collect()], *how)
    _functions[name] = f, kind
    _queries[name] = lambda spark, sf_dir: f(atlas(spark, sf_dir, kind))
    _oracle[name] = f"{_tables(kind)}{tables_} {sql}"


_signature_query("signature", "supplier", TYPES, 200, 1, 1.0)
_signature_query("signature_default", "classes", None, 1000, 10, 0.0)
_signature_query("signature_pval", "customer", TYPES, 30, 1, 0.05)
_signature_query("signature_enriched", "supplier", None, 60, 1, 0.5)


# similarity and mining


def _similar(hits: str, asked: list[str]) -> str:
    return f"""SELECT gene, round(jaccard, {ROUND}) AS jaccard, overlap, n FROM (SELECT gene, overlap / (size + n - overlap) AS jaccard, overlap, n FROM (
SELECT gene, (SELECT count(*) FROM {hits}) AS size, count(h.cell_id) AS overlap, count(*) AS n FROM e LEFT JOIN {hits} h USING (dataset, cell_type, cell_id) WHERE gene NOT IN ({_in(asked) or "''"}) GROUP BY 1)) ORDER BY jaccard DESC, gene DESC LIMIT 5"""


@query(_similar(_AND, B[1:3]))
def similar_genes(a):
    return _rounded(similarity.similar_genes(a, B[1:3]), "jaccard")


@query(_similar(_MIXED, [B[1]]))
def similar_genes_ops(a):
    return _rounded(similarity.similar_genes(a, MIXED), "jaccard")


@query(f"SELECT row_number() OVER (ORDER BY jaccard, gene) AS position, gene FROM ({_similar(_AND, B[1:3])})")
def similar_genes_in_order(a):
    return display.in_order(similarity.similar_genes(a, B[1:3])).select("position", "gene")


def _tfidf(genes: list[str], where: str = "true") -> str:
    return f"""SELECT gene, sum(value / reads) * (SELECT sum(total_cells) FROM types WHERE {where}) / any_value(g.n) AS tfidf FROM e JOIN cells USING (dataset, cell_type, cell_id) JOIN (SELECT gene, count(*) AS n FROM e GROUP BY 1) g USING (gene) WHERE gene IN ({_in(genes)}) AND {where} GROUP BY 1"""


@query(f"SELECT gene, round(tfidf, {ROUND}) AS tfidf FROM ({_tfidf(EIGHT, chr(34) + 'dataset' + chr(34) + ' = ' + _in(['ASIA']))})")
def gene_tfidf(a):
    return _rounded(mining.tfidf(a, EIGHT, ["ASIA"]), "tfidf")


@query(f"""SELECT cutoff FROM (SELECT cutoff, row_number() OVER (ORDER BY cutoff, gene) AS i FROM (SELECT gene, floor(floor(sum(k - 1) / 8) * any_value(s.support / s.cells / ln(8.0)))::BIGINT AS cutoff FROM
(SELECT gene, dataset, cell_type, cell_id, count(*) OVER (PARTITION BY dataset, cell_type, cell_id) AS k FROM e WHERE gene IN ({_in(EIGHT)})), (SELECT count(*) AS support, count(DISTINCT (dataset, cell_type, cell_id)) AS cells FROM e WHERE gene IN ({_in(EIGHT)})) s GROUP BY 1)) WHERE i = 5""")
def cutoff_heuristic(a):
    return mining.cutoff_heuristic(a, EIGHT)


def _sets(genes: list[str], cutoff: int) -> str:
    """Every set of two or more genes, counted on its own."""
    every = [s for r in range(2, len(genes) + 1) for s in combinations(sorted(genes), r)]
    masks = f"(SELECT dataset, cell_type, cell_id, bit_or(CASE gene {' '.join(f'WHEN {chr(39)}{g}{chr(39)} THEN {1 << i}' for i, g in enumerate(sorted(genes)))} END) AS m FROM e WHERE gene IN ({_in(genes)}) GROUP BY 1, 2, 3)"
    values = ", ".join(f"('{','.join(s)}', {sum(1 << sorted(genes).index(g) for g in s)}, {len(s)})" for s in every)
    return f"SELECT query, n_genes, count(*) AS n_cells FROM (VALUES {values}) v(query, bits, n_genes) JOIN {masks} t ON (t.m & v.bits) = v.bits GROUP BY 1, 2 HAVING count(*) >= {cutoff}"


_FIVE = B[1:6]


@query(f"SELECT query, n_cells FROM ({_sets(EIGHT, 5)})")
def frequent_sets(a):
    return mining.frequent_sets(a, EIGHT, cutoff=5).select("query", "n_cells")


def _ranked(genes: list[str], cutoff: int) -> str:
    return f"SELECT n_genes::BIGINT AS n_genes, query, round(score, {ROUND}) AS tfidf, n_cells FROM (SELECT s.query, any_value(n_genes) AS n_genes, any_value(n_cells) AS n_cells, sum(t.tfidf) * min(t.tfidf) AS score FROM ({_sets(genes, cutoff)}) s JOIN ({_tfidf(genes)}) t ON list_contains(string_split(s.query, ','), t.gene) GROUP BY s.query)"


@query(f"SELECT query, n_cells FROM ({_sets(B[1:11], 2)})")
def frequent_sets_exhaustive(a):
    return mining.frequent_sets(a, B[1:11], cutoff=2, exhaustive=True).select("query", "n_cells")


@query(f"SELECT n_genes, query, CASE WHEN tfidf = 0 THEN 0.0 ELSE round(tfidf * power(10.0, 4 - floor(log10(abs(tfidf))))) / power(10.0, 4 - floor(log10(abs(tfidf)))) END AS tfidf, n_cells FROM ({_ranked(_FIVE, 1)})".replace(f"round(score, {ROUND})", "score"))
def recommended_queries(a):
    return mining.recommended_queries(a, _FIVE, a.datasets())


@query(_ranked(_FIVE, 1))
def marker_genes(a):
    return _rounded(mining.marker_genes(a, _FIVE), "tfidf")


@query(_ranked(_FIVE, 3))
def marker_genes_exhaustive(a):
    return _rounded(mining.marker_genes(a, _FIVE, exhaustive=True, support_cutoff=3), "tfidf")


@query(f"SELECT i::BIGINT AS position, gene FROM (SELECT unnest(string_split(query, ',')) AS gene, generate_subscripts(string_split(query, ','), 1) AS i FROM ({_ranked(_FIVE, 1)} ORDER BY tfidf DESC, query LIMIT 1))")
def best_subquery(a):
    return mining.best_subquery(mining.marker_genes(a, _FIVE))


# merging, saving, values


def _of(a: Atlas, datasets: list[str]) -> Atlas:
    return Atlas(*[lookup.scoped(a, t, datasets) for t in (a.expression, a.cells, a.cell_types)], a.qb, tasks=a.tasks)


@query("SELECT gene, sum(n_cells)::BIGINT AS total_reads FROM sup GROUP BY 1")
def merge_datasets(a):
    names = a.datasets()
    return merge(_of(a, names[:2]), _of(a, names[2:])).genes.select("gene", "total_reads")


@query("SELECT dataset, cell_type, cell_id, gene, value FROM e", "barcodes")
def repeated_cells(a):
    """Entries of an index whose datasets have cells of the same names."""
    return a.expression


@query("SELECT dataset, cell_type, cell_id, reads, features FROM cells", "barcodes")
def repeated_cells_meta(a):
    return a.cells


@query("SELECT gene, sum(n_cells)::BIGINT AS total_reads FROM sup GROUP BY 1", "customer")
def merge_wide_dataset(a):
    """The datasets but one, and that one from a frame with a column for each gene."""
    *names, last = a.datasets()
    cells = _of(a, [last])
    key = ["label", "cell_id"]
    wide = cells.cells.join(cells.cell_types.select("cell_type", "label"), "cell_type").select(*key, "cell_type")
    values = cells.expression.groupBy("cell_type", "cell_id").pivot("gene", [r.gene for r in a.genes.select("gene").collect()]).agg(F.first("value"))
    wide = wide.join(values, ["cell_type", "cell_id"], "left").withColumn("cell", F.concat_ws("/", "label", F.lpad(F.col("cell_id").cast("string"), 12, "0"))).withColumnRenamed("label", "cell_type1").drop("cell_type", "cell_id").fillna(0.0)
    return tables.merge_wide(_of(a, names), wide, last).genes.select("gene", "total_reads")


@query(f"SELECT gene, cell_type, n_cells FROM sup WHERE gene IN ({_in(B[1:4])})")
def exported_csv(a):
    """What is exported, as it is read again."""
    path = f"{shared_folder(a.spark)}/export/{uuid.uuid4().hex}"
    out = lookup.gene_support_by_type(a, B[1:4])
    tables.to_csv(out, path)
    return a.spark.read.schema(out.schema).option("header", True).csv(path)


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/atlas/{uuid.uuid4().hex}"
    tables.save(atlas(spark, sf_dir), path)
    return tables.load(spark, path).expression


def _build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index built anew, nothing kept in memory."""
    a = tables.driver_atlas(spark, sf_dir)
    counts = [a.expression.agg(F.count("*").alias("entries"), F.sum("value").alias("reads")), a.cells.agg(F.count("*").alias("cells"), F.sum("features").alias("features")), a.cell_types.agg(F.count("*").alias("types"))]
    return counts[0].crossJoin(F.broadcast(counts[1])).crossJoin(F.broadcast(counts[2]))  # one row each


def _kept(spark: SparkSession, sf_dir: str, kind: str, how: str, make: Callable[[str], None]) -> Atlas:
    """An index read from files, which are made once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, f"{how} {kind}")
    if key not in _atlases:
        path = f"{shared_folder(spark)}/atlas/{uuid.uuid4().hex}"
        make(path)
        _atlases[key] = tables.load(spark, path)
    return _atlases[key]


def _reloaded(spark: SparkSession, sf_dir: str, kind: str = "orders") -> Atlas:
    """The index as it is saved, read from its files."""
    return _kept(spark, sf_dir, kind, "reloaded", lambda path: tables.save(atlas(spark, sf_dir, kind), path))


def _grown(spark: SparkSession, sf_dir: str, kind: str = "orders") -> Atlas:
    """The index grown in three appends, of some datasets each; the second is repeated, which changes nothing."""

    def make(path: str) -> None:
        a = atlas(spark, sf_dir, kind)
        names = a.datasets()
        for name, some in (("first", names[:2]), ("second", names[2:4]), ("second", names[2:4]), ("third", names[4:])):
            tables.append(_of(a, some), path, name)

    return _kept(spark, sf_dir, kind, "grown", make)


_queries["build_index"] = _build
_oracle["build_index"] = f"{_tables('orders')} SELECT (SELECT count(*) FROM e) AS entries, (SELECT sum(value) FROM e) AS reads, (SELECT count(*) FROM cells) AS cells, (SELECT sum(features) FROM cells)::BIGINT AS features, (SELECT count(*) FROM types) AS types"
#: Queries that are also put to an index that is read from its files, some of each family; and to one grown by appends.
RELOADED = ["genes_list", "case_correct", "gene_support", "gene_support_ct", "zero_support_parts", "decode_postings", "query_genes_or", "and_query", "or_query", "not_query", "not_or_query", "mixed_query", "complement_query", "dataset_scoped_query", "query_cells_by_type", "contingency_table", "hyper_query", "markers_topk", "evaluate_markers_and", "ct_specificity", "tissue_specificity", "housekeeping", "signature", "similar_genes", "similar_genes_ops", "gene_tfidf", "frequent_sets_exhaustive", "marker_genes", "quantized_expression", "cell_type_expression"]
GROWN = ["genes_list", "case_correct", "gene_support", "mixed_query", "complement_query", "hyper_query", "markers_topk", "similar_genes"]


def _put_to_files() -> None:
    for names, how, at in ((RELOADED, "reloaded", _reloaded), (GROWN, "grown", _grown)):
        for name in names:
            f, kind = _functions[name]
            _queries[f"{how}_{name}"] = lambda spark, sf_dir, f=f, kind=kind, at=at: f(at(spark, sf_dir, kind))
            _oracle[f"{how}_{name}"] = _oracle[name]


_queries["save_load_roundtrip"] = _round_trip
_oracle["save_load_roundtrip"] = f"{_tables('orders')} SELECT dataset, cell_type, cell_id, gene, value FROM e"


@query(f"SELECT g.gene, c.cell_id, coalesce(value, 0.0) AS value FROM (SELECT DISTINCT gene FROM e WHERE cell_type = '{TYPE}') g CROSS JOIN (SELECT cell_id FROM cells WHERE cell_type = '{TYPE}') c LEFT JOIN (SELECT gene, cell_id, value FROM e WHERE cell_type = '{TYPE}') v ON v.gene = g.gene AND v.cell_id = c.cell_id", "customer")
def cell_type_expression(a):
    return codec.cell_type_expression(a, TYPE)


def _phi(x: str) -> str:
    poly = "0.0"
    for c in reversed(ERF):
        poly = f"(t * ({c} + {poly}))"
    return f"CASE WHEN sigma = 0 THEN 0.5 ELSE 0.5 * (1 + sign(z) * (1 - {poly} * exp(-z * z))) END"


_QUANTILE = f"(code + 0.5) / 4"
_LN = "ln(1 - power(2 * q - 1, 2))"
_INV = f"sign(2 * q - 1) * sqrt(sqrt(power({2 / (math.pi * WINITZKI)} + {_LN} / 2, 2) - {_LN} / {WINITZKI}) - ({2 / (math.pi * WINITZKI)} + {_LN} / 2))"


@query(f"""SELECT gene, cell_type, cell_id, code, round(exp({_INV} * sqrt(2.0) * sigma + mu) - 1, 4) AS decoded FROM (SELECT *, {_QUANTILE} AS q FROM (
SELECT gene, cell_type, cell_id, mu, sigma, least(3, floor(round({_phi('x')} * 4, 6) + 0.5))::BIGINT AS code FROM (SELECT *, 1 / (1 + {ERF_P} * abs(z)) AS t FROM (SELECT *, (ln(1 + value) - mu) / nullif(sigma, 0) / sqrt(2.0) AS z FROM e JOIN (SELECT gene, cell_type, avg(ln(1 + value)) AS mu, stddev_pop(ln(1 + value)) AS sigma FROM e GROUP BY 1, 2) USING (gene, cell_type)))))""", "customer")
def quantized_expression(a):
    return codec.dequantise(codec.quantise(a), a.qb).select("gene", "cell_type", "cell_id", "code", F.round("decoded", 4).alias("decoded"))


_PHI2 = _phi("x").replace("sigma = 0", "sigma = 0 AND next < mu").replace("THEN 0.5 ELSE", "THEN 0.0 WHEN sigma = 0 THEN 1.0 ELSE")


@query(f"""SELECT gene, cell_type, cell_id, code, round(exp({_INV} * sqrt(2.0) * sigma + mu), 4) AS decoded FROM (SELECT *, (CASE code WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 3 END + 0.5) / 4 AS q FROM (
SELECT gene, cell_type, cell_id, mu, sigma, floor(round({_PHI2} * 4, 6) + 0.5)::BIGINT % 4 AS code FROM (SELECT *, 1 / (1 + {ERF_P} * abs(z)) AS t FROM (SELECT *, (next - mu) / nullif(sigma, 0) * sqrt(2.0) AS z FROM (
SELECT gene, cell_type, cell_id, mu, abs(mu - last) / sqrt(n) AS sigma, CASE WHEN lead(cell_id) OVER posting = cell_id + 1 THEN ln(1 + lead(value) OVER posting) ELSE 0.0 END AS next FROM e JOIN (SELECT gene, cell_type, avg(ln(1 + value)) AS mu, arg_max(ln(1 + value), cell_id) AS last, count(*) AS n FROM e GROUP BY 1, 2) USING (gene, cell_type) WINDOW posting AS (PARTITION BY gene, cell_type ORDER BY cell_id))))))""", "customer")
def quantized_compat(a):
    return codec.dequantise(codec.quantise(a, codec="compat"), a.qb, "compat").select("gene", "cell_type", "cell_id", "code", F.round("decoded", 4).alias("decoded"))


@query(f"""SELECT gene, cell_id, round(coalesce(decoded, 0), 4) AS value FROM (SELECT DISTINCT gene FROM e WHERE cell_type = '{TYPE}') CROSS JOIN (SELECT cell_id FROM cells WHERE cell_type = '{TYPE}') LEFT JOIN (
SELECT gene, cell_id, exp({_INV} * sqrt(2.0) * sigma + mu) - 1 AS decoded FROM (SELECT *, {_QUANTILE} AS q FROM (SELECT gene, cell_id, mu, sigma, least(3, floor(round({_phi('x')} * 4, 6) + 0.5))::BIGINT AS code FROM (SELECT *, 1 / (1 + {ERF_P} * abs(z)) AS t FROM (
SELECT *, (ln(1 + value) - mu) / nullif(sigma, 0) / sqrt(2.0) AS z FROM (SELECT * FROM e WHERE cell_type = '{TYPE}') JOIN (SELECT gene, avg(ln(1 + value)) AS mu, stddev_pop(ln(1 + value)) AS sigma FROM e WHERE cell_type = '{TYPE}' GROUP BY 1) USING (gene)))))) USING (gene, cell_id)""", "customer")
def cell_type_expression_quantised(a):
    return codec.cell_type_expression(a, TYPE, quantised=True).withColumn("value", F.round("value", 4))


@query(f"SELECT gene, list(value ORDER BY cell_id)::VARCHAR AS vector FROM (SELECT g.gene, c.cell_id, coalesce(value, 0)::BIGINT AS value FROM (SELECT DISTINCT gene FROM e WHERE cell_type = '{TYPE}') g CROSS JOIN (SELECT cell_id FROM cells WHERE cell_type = '{TYPE}') c LEFT JOIN (SELECT gene, cell_id, value FROM e WHERE cell_type = '{TYPE}') v ON v.gene = g.gene AND v.cell_id = c.cell_id) GROUP BY 1", "customer")
def cell_type_vectors(a):
    """The arrays of each gene, block by block, as one string."""
    parts = codec.cell_type_vectors(a, TYPE).select("gene", F.struct("cell_block", F.array_join(F.transform("values", lambda v: v.cast("long").cast("string")), ", ").alias("v")).alias("p"))
    return parts.groupBy("gene").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["v"]), ", "), F.lit("]")).alias("vector"))


# front end

REGIONS = "chr13:500-60000 , CHR5:1000-90000 chr7_100_70000 chr5:9-3"
_PEAKS = "SELECT 'chr' || p_size || '_' || p_partkey * 100 || '_' || (p_partkey * 100 + 50) AS gene, 'chr' || p_size AS chromosome, p_partkey * 100 AS p_start, p_partkey * 100 + 50 AS p_end FROM part"
_LOCI = f"SELECT input, gene, chromosome, q_start AS loc_1, p_start AS loc_2, p_end AS loc_3, q_end AS loc_4, p_start - q_start AS gap_before, p_end - p_start AS width, q_end - p_end AS gap_after FROM ({_PEAKS}) p JOIN (VALUES ('chr13:500-60000', 'chr13', 500::BIGINT, 60000::BIGINT), ('chr5:1000-90000', 'chr5', 1000::BIGINT, 90000::BIGINT), ('chr7:100-70000', 'chr7', 100::BIGINT, 70000::BIGINT)) q(input, q_chr, q_start, q_end) ON chromosome = q_chr AND p_start >= q_start AND p_end <= q_end"


def peak_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.text import locus_name

    return intervals.peaks_within(tables.driver_peaks(spark, sf_dir), REGIONS).select("input", locus_name(F.col("gene")).alias("peak"))


def loci_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.loci(tables.driver_peaks(spark, sf_dir), REGIONS)


#: A region for each customer, of widths from a few bases to a whole chromosome.
_MANY = "SELECT 'r' || c_custkey AS input, 'chr' || (c_custkey % 50 + 1) AS q_chr, (c_custkey * 37 % 190000)::BIGINT AS q_start, (c_custkey * 37 % 190000 + 40 * power(7, c_custkey % 9))::BIGINT AS q_end FROM customer"


def loci_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks in as many regions as there are customers."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    start = (F.col("c_custkey") * 37 % 190000).cast("long")
    asked = c.select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("input"), F.concat(F.lit("chr"), (F.col("c_custkey") % 50 + 1).cast("string")).alias("q_chromosome"), start.alias("q_start"), (start + 40 * F.pow(F.lit(7), F.col("c_custkey") % 9)).cast("long").alias("q_end"))
    return intervals.with_gaps(intervals.peaks_in(tables.driver_peaks(spark, sf_dir), asked))


_queries |= {"peak_interval": peak_interval, "loci_regions": loci_regions, "loci_many": loci_many}
_oracle |= {"peak_interval": f"SELECT input, chromosome || ':' || loc_2 || '-' || loc_3 AS peak FROM ({_LOCI})", "loci_regions": _LOCI, "loci_many": f"SELECT input, gene, chromosome, q_start AS loc_1, p_start AS loc_2, p_end AS loc_3, q_end AS loc_4, p_start - q_start AS gap_before, p_end - p_start AS width, q_end - p_end AS gap_after FROM ({_PEAKS}) p JOIN ({_MANY}) q ON chromosome = q_chr AND p_start >= q_start AND p_end <= q_end"}


@query(f"SELECT c.dataset, c.cell_type, c.cell_id, (c.cell_id % 10)::DOUBLE AS x, floor(c.cell_id / 10)::DOUBLE AS y, h.cell_id IS NOT NULL AS hit FROM cells c LEFT JOIN {_AND} h USING (dataset, cell_type, cell_id) WHERE c.cell_type IN ({_in(TYPES)})")
def umap_hits(a):
    umap = a.cells.select("dataset", "cell_type", "cell_id", (F.col("cell_id") % 10).cast("double").alias("x"), F.floor(F.col("cell_id") / 10).cast("double").alias("y"))
    return display.umap_hits(umap, boolean.find(a, B[1:3]), TYPES)


@query(f"SELECT cell_type, count(*) AS cell_hits, 'asia' AS tag FROM {_AND} WHERE dataset = 'ASIA' GROUP BY 1 UNION ALL SELECT cell_type, count(*) AS cell_hits, 'europe' AS tag FROM {_AND} WHERE dataset = 'EUROPE' GROUP BY 1")
def union_tagged(a):
    one = lambda d: boolean.find(a, B[1:3], [d]).groupBy("cell_type").agg(F.count("*").alias("cell_hits"))
    return display.tagged_union(asia=one("ASIA"), europe=one("EUROPE"))


_put_to_files()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)
