"""Connected components over links: each task makes stars of its own, large-star and small-star steps tie those of many."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, released

#: Links that one task makes stars of at once.
LINKS = 1 << 20


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' components, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links (u, v) with v the smaller; each node's neighbours are tied to the least of them."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = near.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _stars(whole: bool):
    """Links (u, v) of one task's nodes to the least of those that its links connect; if they are all links there
    are, that one's own row too."""

    @released
    def run(batches):
        got = [[b.column(i).to_numpy() for i in (0, 1)] for b in batches]
        if not got:
            return
        u, v = (np.concatenate(x) for x in zip(*got, strict=True))
        nodes, at = np.unique(np.r_[u, v], return_inverse=True)
        root = local_components(len(nodes), at[: len(u)], at[len(u) :])
        shown = whole | (root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[shown]), pa.array(nodes[root][shown])], names=["u", "v"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link, from links (u, v) of longs. Links stay in the cluster, in tasks
    of LINKS at most as long as they are dealt evenly; where one task holds them all, its stars are the components.
    Each round ends in a reliable checkpoint, and the driver sees two numbers of it."""
    now = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        tasks = max(1, math.ceil(state[0] / LINKS))
        if tasks == 1:
            return checkpoint(now.coalesce(1).mapInArrow(_stars(True), "u long, v long")).toDF("node", "root")
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
        stars = checkpoint(now.coalesce(tasks).mapInArrow(_stars(False), "u long, v long"))
        now = checkpoint(_star(_star(stars, large=True), large=False))
