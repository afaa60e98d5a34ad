"""Connected components of an edge table, without a driver-side graph.

Large-star and small-star steps in turn (Kiveris et al., 2014) until no edge
changes: every node then has one edge, to the smallest node of its component.
Each step is a minimum by node, combined before the shuffle, and a join that
adaptive execution may split where one node has most edges. A step's result is
written to the shared folder, so a lost executor repeats one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a"), F.least("a", "low").alias("low"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    rest = edges.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return rest.unionByName(low.select("a", F.col("low").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; ``edges`` has a and b.

    Self-loops, repeats and either direction are allowed; nulls are dropped.
    """
    scratch = Scratch(edges.sparkSession, "components")
    edges = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0")
    mark, before, step = _mark(edges), None, 0
    while mark[0] and mark != before:
        large = scratch.keep(_large(edges).distinct(), f"large-{step}")
        edges = scratch.keep(_small(large).distinct(), f"edges-{step + 1}")
        before, mark = mark, _mark(edges)
        scratch.drop(f"large-{step}", f"edges-{step}")
        step += 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
