"""Connected components of an edge table by alternating large and small stars.

Defined cases: edges are read in either direction and repeated ones once; an edge from a node to itself makes no
component, nor does an edge with a null end; a table without edges gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusx.scratch import Scratch


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's neighbours (large: those above it) are tied to the least of them all."""
    if large:
        near = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        out = near.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        below = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = below.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        tied = below.join(least, F.col("u") == F.col("w")).select(F.col("m").alias("a"), F.col("v").alias("b"))
        out = tied.unionByName(least.select(F.col("m").alias("a"), F.col("w").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of an edge table (a, b): root is the least node of its component.

    A table of stars is a fixed point; each step is written and counted, so it ends when a large
    and a small star together change nothing.
    """
    state = scratch.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        big = scratch.keep(stars(state, True), "large")
        new = scratch.keep(stars(big, False), "small")
        scratch.drop(big, state)
        state = new
    return state.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(state.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
