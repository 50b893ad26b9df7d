"""How widely genes are expressed: specificities, housekeeping genes, signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import holm, with_hyper_tail
from ..plans.atlas import Atlas
from ..sources.shared import written
from .lookup import resolve_genes, scoped
from .markers import score


def _asked(atlas: Atlas, genes: list[str] | None) -> DataFrame:
    if genes is None:
        return atlas.genes.select("gene")
    known = list(dict.fromkeys(resolve_genes(atlas, genes).values()))
    return atlas.genes.where(F.col("gene").isin(known)).select("gene")


def _counted(asked: DataFrame, found: DataFrame, name: str) -> DataFrame:
    n = found.groupBy("gene").agg(F.count("*").alias(name))
    return asked.join(n, "gene", "left").select("gene", F.coalesce(name, F.lit(0)).alias(name))


def cell_type_specificity(atlas: Atlas, genes: list[str] | None = None, datasets: list[str] | None = None, min_cells: int = 10, min_fraction: float = 0.25) -> DataFrame:
    """(gene, n_types): types where the gene is in more than min_cells cells and more than the fraction."""
    if not 0 < min_fraction < 1:
        raise ValueError("min_fraction must be between 0 and 1")
    s = scoped(atlas, atlas.support, datasets).join(atlas.cell_types.select("cell_type", "total_cells"), "cell_type")
    wide = s.where(F.col("n_cells") > F.greatest(F.lit(float(min_cells)), F.col("total_cells") * min_fraction))
    return _counted(_asked(atlas, genes), wide, "n_types")


def tissue_specificity(atlas: Atlas, genes: list[str] | None = None, min_cells: int = 10) -> DataFrame:
    """(gene, n_datasets): datasets where the gene is in more than min_cells cells."""
    if len(atlas.datasets()) <= 1:
        raise ValueError("the index has one dataset only")
    wide = atlas.support.groupBy("dataset", "gene").agg(F.sum("n_cells").alias("n")).where(F.col("n") > min_cells)
    return _counted(_asked(atlas, genes), wide, "n_datasets")


def housekeeping(atlas: Atlas, cell_types: list[str], min_recall: float = 0.5, max_genes: int = 1000) -> DataFrame:
    """Genes that are among the max_genes of highest recall in every type, and above min_recall there. More genes than
    there are, or no such gene, is an error."""
    if not 0 < min_recall < 1:
        raise ValueError("min_recall must be between 0 and 1")
    if max_genes > (n := atlas.genes.count()):
        raise ValueError(f"max_genes must be at most {n}, the number of genes")
    types = list(dict.fromkeys(cell_types))
    best = Window.partitionBy("cell_type").orderBy(F.col("recall").desc(), "gene")
    top = score(atlas, types).withColumn("nth", F.row_number().over(best)).where((F.col("nth") <= max_genes) & (F.col("recall") > min_recall))
    found = top.groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") == len(types)).select("gene")
    if found.isEmpty():
        raise ValueError("no housekeeping gene is found")
    return found


#: Positions that a first pass over signatures looks at; each further one looks at four times as many.
FIRST = 16
#: Rows of ranked genes up to which they are sent to where the entries are.
SENT = 100_000


def signature(atlas: Atlas, cell_types: list[str], max_genes: int = 1000, min_cells: int = 10, max_pval: float = 0.0) -> DataFrame:
    """(target, position, gene): for each type its genes by recall, as long as the cells that have all of them
    so far hold the type, enriched enough, in as many cells as it has (or min_cells if that is more). A list
    that no cell at all satisfies goes on. Lists mostly end early, so a pass looks at the first positions only, and those
    that haven't ended by then at more; the driver sees one number for each type."""
    best = Window.partitionBy("cell_type").orderBy(F.col("recall").desc(), "gene")
    lower = [t.lower() for t in cell_types]
    names = [r.cell_type for r in atlas.cell_types.where(F.lower("cell_type").isin(lower)).select("cell_type").collect()]
    ranked = score(atlas, names).withColumn("position", F.row_number().over(best)).where(F.col("position") <= max_genes).select(F.col("cell_type").alias("target"), "position", "gene")
    width = FIRST
    while True:
        judged = written(_judged(atlas, ranked.where(F.col("position") <= width), len(names) * width, min_cells, max_pval), "signatures")
        longest = judged.agg(F.max("position")).first()[0] or 0
        if longest < width or width >= max_genes:
            return judged
        width *= 4


def _judged(atlas: Atlas, ranked: DataFrame, rows: int, min_cells: int, max_pval: float) -> DataFrame:
    """The ranked genes before the first at which each list ends. Every list is a prefix, so the length of a cell's unbroken
    prefix tells its hits: all prefixes' are sums over lengths. Cells of a type with the same ranked genes have the same
    prefixes, so each set of genes is held against the lists once, and only against those whose first gene it has."""
    lists = ranked.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "gene"))), lambda p: p["gene"]).alias("list")).withColumn("first", F.element_at("list", 1))
    wanted = ranked.select("gene").distinct()
    met = atlas.expression.select("cell_type", "cell_id", "gene").join(F.broadcast(wanted) if rows <= SENT else wanted, "gene", "left_semi")
    sets = met.groupBy("cell_type", "cell_id").agg(F.array_sort(F.collect_list("gene")).alias("genes")).groupBy("cell_type", "genes").agg(F.count("*").alias("n"))
    led = sets.withColumn("first", F.explode("genes")).join(lists, "first")
    missing = F.get(F.array_except("list", "genes"), F.lit(0))  # what is left stands in the list's order
    length = F.when(missing.isNull(), F.size("list")).otherwise(F.array_position("list", missing) - 1).cast("int")
    per = led.select("target", "cell_type", length.alias("length"), "n").groupBy("target", "cell_type", "length").agg(F.sum("n").alias("n"))
    hits = per.select("target", "cell_type", "n", F.explode(F.sequence(F.lit(1), F.col("length"))).alias("position")).groupBy("target", "cell_type", "position").agg(F.sum("n").alias("x"))
    rows = hits.join(atlas.cell_types.select("cell_type", F.col("total_cells").alias("m")), "cell_type")
    step = Window.partitionBy("target", "position")
    rows = rows.withColumns({"k": F.sum("x").over(step), "u": F.sum("m").over(step)})
    # few rows, each a sum of many terms: dealt out, or they would be one task's
    dealt = rows.repartition(int(atlas.spark.conf.get("spark.sql.shuffle.partitions")), "target", "position", "cell_type")
    rows = with_hyper_tail(dealt, "x", "m", "u", "k", "p")
    n = atlas.cell_types.agg(F.count("*").alias("__n"))
    rows = holm(rows.join(F.broadcast(n)), "p", F.col("__n"), ["target", "position"])
    own = F.max(F.when(F.col("cell_type") == F.col("target"), F.struct("x", "m", "p")))
    found = rows.groupBy("target", "position").agg(own.alias("own"), F.lit(True).alias("some"))
    judged = ranked.join(found, ["target", "position"], "left").select("target", "position", "gene", "own.x", "own.m", "own.p", "some")
    bad = F.col("some").isNotNull() & (F.col("x").isNull() | (F.col("p") > max_pval) | (F.col("x") < F.greatest(F.lit(min_cells), F.col("m"))))
    so_far = Window.partitionBy("target").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return judged.withColumn("stop", F.max(bad.cast("int")).over(so_far)).where("stop = 0").select("target", "position", "gene")
