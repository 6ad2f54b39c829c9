"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A node's edges are dealt to so many tasks, so that no task holds all of a node that many others hang on.
SALTS = 16


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.xxhash64("b").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Hangs neighbours of a node on the least one: the larger neighbours, or the smaller ones and the node itself."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hung = both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(salted, ["a", "salt"])
    if small:
        own = least.select("a", F.col("m").alias("b"))
        return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).filter("a != b").distinct()
    return hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): each node that has an edge and is not the least of its component, with that least node.

    edges (a, b) are of any type with an order, in any order. Each round's edges are written to the shared folder; rounds
    end when they no longer change."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    state = _state(now)
    while state[0]:
        now = cut(_stars(_stars(now, small=False), small=True))
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
