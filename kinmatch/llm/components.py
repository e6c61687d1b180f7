"""Connected components of an edge table by alternating large-star and small-star steps.

Each step sends every node's neighbours to the smallest of them. Neighbour lists are never collected: a step is a
pre-aggregated minimum and a join with it. Both sides of the join are dealt by the node and a salt of the neighbour, so
the edges of a node with very many neighbours go to SALTS tasks. After each round the edges are written to the shared
checkpoint folder. The rounds end when the edges are stars, each around the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import Scratch

#: Tasks that the edges of one node are dealt to at most.
SALTS = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v, distinct. Large star: links every larger neighbour of a node to the smallest of its neighbours and
    itself. Small star: links the smaller neighbours, and the node, to the smallest."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    both = both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    # The minimum goes only to salts that occur, so this side has no more rows than the other.
    low = both.groupBy("a", "salt").agg(F.min("b").alias("low")).groupBy("a").agg(F.min("low").alias("low"), F.collect_list("salt").alias("salts"))
    low = low.withColumn("low", F.least("low", "a"))
    joined = both.join(low.select("a", "low", F.explode("salts").alias("salt")).hint("merge"), ["a", "salt"])
    if large:
        return joined.where("b > a AND b <> low").select(F.col("b").alias("u"), F.col("low").alias("v")).distinct()
    links = joined.where("b <> low").select(F.col("b").alias("u"), F.col("low").alias("v"))
    return links.unionByName(low.where("a <> low").select(F.col("a").alias("u"), F.col("low").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or both a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(edges: DataFrame, held: Scratch) -> DataFrame:
    """edges: columns a, b of one type without nulls -> node, component (the smallest node that can be reached).

    Only nodes with an edge to another node appear. Loops, repeated and reversed edges do no harm.
    """
    now = held.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _are_stars(now):
        after = held.table(_star(_star(now, True), False), "edges")
        held.drop(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
