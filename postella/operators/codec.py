"""Quantised values and the expression matrix of a type."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import log_normal_quantile, normal_cdf
from ..plans.atlas import Atlas, check_bits


def quantise(atlas: Atlas, bits: int | None = None, codec: str = "clamped") -> DataFrame:
    """Entries with the mean and deviation of log(1 + value) in their posting, and the code of their quantile.

    `clamped`: the population deviation, the standard normal CDF, and the highest code for the uppermost quantile. `compat`
    gives the codes of indexes built by the older implementation: the deviation is the distance of the posting's last cell
    from the mean over the root of the number of cells, a cell's code is that of the value in the next cell of its type (0 where that
    has none), the CDF is taken at twice the distance, and the uppermost quantile wraps to 0. What isn't
    defined there is here: after the type's last cell comes a 0, and where the deviation is 0 values below
    the mean are at quantile 0, others at 1."""
    bits = check_bits(bits or atlas.qb)
    e = atlas.expression.withColumn("x", F.log1p("value"))
    posting = ["gene", "cell_type"]
    if codec == "clamped":
        stats = e.groupBy(*posting).agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sigma"))
        share = normal_cdf(F.col("x"), F.col("mu"), F.col("sigma"))
    elif codec == "compat":
        last = e.groupBy(*posting).agg(F.avg("x").alias("mu"), F.max_by("x", "cell_id").alias("last"), F.count("*").alias("n"))
        stats = last.select(*posting, "mu", (F.abs(F.col("mu") - F.col("last")) / F.sqrt("n")).alias("sigma"))
        # the next cell of the type stands one number on; a join finds it, so no posting is one task's
        following = e.select(*posting, (F.col("cell_id") - 1).alias("cell_id"), F.col("x").alias("next"))
        e = e.join(following, [*posting, "cell_id"], "left").withColumn("next", F.coalesce("next", F.lit(0.0)))
        share = F.when(F.col("sigma") == 0, F.when(F.col("next") < F.col("mu"), 0.0).otherwise(1.0)).otherwise(normal_cdf(F.col("next"), F.col("mu"), F.col("sigma") / 2))
    else:
        raise ValueError(f"no codec {codec!r}; there are clamped and compat")
    code = F.floor(F.round(share * (1 << bits), 6) + 0.5)
    code = F.least(F.lit((1 << bits) - 1), code) if codec == "clamped" else code % (1 << bits)
    return e.join(stats, posting).select("dataset", "cell_type", "cell_id", "gene", "value", "mu", "sigma", code.cast("long").alias("code"))


def dequantise(codes: DataFrame, bits: int, codec: str = "clamped") -> DataFrame:
    """Values at the middle of each code's interval. `compat` decodes as the older implementation does: a code of zeros alone stands for
    the second interval, of ones alone for the third, any other for the fourth (null where there are not so many), and the
    value is that of 1 more."""
    n = 1 << bits
    if codec == "clamped":
        return codes.withColumn("decoded", log_normal_quantile((F.col("code") + 0.5) / n, F.col("mu"), F.col("sigma")))
    # fixed values: the intervals that codes of zeros, of ones and of both stand for
    interval = F.when(F.col("code") == 0, 1).when(F.col("code") == n - 1, 2).otherwise(3)
    decoded = log_normal_quantile((interval + 0.5) / n, F.col("mu"), F.col("sigma")) + 1
    return codes.withColumn("decoded", F.when(interval < n, decoded))


def _entries(atlas: Atlas, cell_type: str, quantised: bool) -> DataFrame:
    """(gene, cell_id, value) of the type's entries, values as they are or as their codes decode."""
    e = atlas.expression.where(F.col("cell_type") == cell_type)
    if quantised:
        one = Atlas(e, atlas.cells, atlas.cell_types, atlas.qb)
        return dequantise(quantise(one), atlas.qb).select("gene", "cell_id", F.col("decoded").alias("value"))
    return e.select("gene", "cell_id", "value")


#: Genes and cells of a tile of a matrix: no row is larger, whatever the type.
TILE_GENES, TILE_CELLS = 64, 2048
#: Columns up to which a matrix is made wide.
WIDE = 10_000


def cell_type_tiles(atlas: Atlas, cell_type: str, quantised: bool = False) -> DataFrame:
    """(gene_block, cell_block, genes, n_cells, row, column, value): the matrix of the type, genes in order by cells in order,
    cut into tiles. genes names a tile's rows, n_cells says how many columns it has; row and column (from 0 in the tile) and value
    are arrays of what isn't zero, by rows. Tiles of zeros alone are there, with empty arrays."""
    mine = atlas.support.where(F.col("cell_type") == cell_type).select("gene")
    # a number for each gene of one type, as many as the vocabulary has at most
    numbered = mine.select("gene", (F.row_number().over(Window.orderBy("gene")) - 1).alias("g")).select("gene", F.floor(F.col("g") / TILE_GENES).alias("gene_block"), (F.col("g") % TILE_GENES).cast("int").alias("row"))
    names = numbered.groupBy("gene_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "gene"))), lambda p: p["gene"]).alias("genes"))
    total = atlas.cell_types.where(F.col("cell_type") == cell_type).select("total_cells", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total_cells") - 1) / TILE_CELLS))).alias("cell_block"))
    columns = total.select("cell_block", F.least(F.lit(TILE_CELLS), F.col("total_cells") - F.col("cell_block") * TILE_CELLS).cast("int").alias("n_cells"))
    at = F.col("cell_id") - 1
    e = _entries(atlas, cell_type, quantised).join(numbered, "gene").select("gene_block", F.floor(at / TILE_CELLS).alias("cell_block"), "row", (at % TILE_CELLS).cast("int").alias("column"), "value")
    sparse = e.groupBy("gene_block", "cell_block").agg(F.array_sort(F.collect_list(F.struct("row", "column", "value"))).alias("e"))
    tiles = names.crossJoin(columns).join(sparse, ["gene_block", "cell_block"], "left")  # every tile once: a few thousandths of the matrix
    part = lambda f, kind: F.coalesce(F.col("e")[f], F.array().cast(f"array<{kind}>")).alias(f)
    return tiles.select("gene_block", "cell_block", "genes", "n_cells", part("row", "int"), part("column", "int"), part("value", "double"))


def _dense(batches):
    """Of tiles each as a block of numbers, with its genes and the first of its cells."""
    for b in batches:
        for t in b.to_pylist():
            block = np.zeros((len(t["genes"]), t["n_cells"]))
            block[np.array(t["row"], int), np.array(t["column"], int)] = t["value"]
            yield t, block


def cell_type_expression(atlas: Atlas, cell_type: str, quantised: bool = False) -> DataFrame:
    """(gene, cell_id, value): every gene of the type by every cell of it, zeros included."""

    def run(batches):
        for t, block in _dense(batches):
            cells = np.arange(1, t["n_cells"] + 1) + t["cell_block"] * TILE_CELLS
            genes = pa.array(t["genes"]).take(pa.array(np.repeat(np.arange(len(block)), t["n_cells"])))
            yield pa.RecordBatch.from_arrays([genes, pa.array(np.tile(cells, len(block))), pa.array(block.ravel())], names=["gene", "cell_id", "value"])

    return cell_type_tiles(atlas, cell_type, quantised).mapInArrow(run, "gene string, cell_id long, value double")


def cell_type_vectors(atlas: Atlas, cell_type: str, quantised: bool = False) -> DataFrame:
    """(gene, cell_block, values): the same with an array for each gene and TILE_CELLS cells, in the order of cells."""

    def run(batches):
        for t, block in _dense(batches):
            yield pa.RecordBatch.from_arrays([pa.array(t["genes"]), pa.array(np.full(len(block), t["cell_block"])), pa.array(list(block), pa.list_(pa.float64()))], names=["gene", "cell_block", "values"])

    return cell_type_tiles(atlas, cell_type, quantised).mapInArrow(run, "gene string, cell_block long, values array<double>")


def cell_type_matrix(atlas: Atlas, cell_type: str, quantised: bool = False) -> DataFrame:
    """The same as a wide frame with a column for each cell. A type of more than WIDE cells is an error; it has tiles and vectors."""
    n = atlas.cell_types.where(F.col("cell_type") == cell_type).agg(F.coalesce(F.sum("total_cells"), F.lit(0))).first()[0]
    if n > WIDE:
        raise ValueError(f"{cell_type} has {n} cells, more than a frame can have columns: cell_type_tiles and cell_type_vectors have it in parts")
    blocks = cell_type_vectors(atlas, cell_type, quantised).groupBy("gene").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cell_block", "values"))), lambda p: p["values"])).alias("values"))
    return blocks.select("gene", *[F.get("values", F.lit(i)).alias(str(i + 1)) for i in range(n)])
