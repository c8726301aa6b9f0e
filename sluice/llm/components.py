"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.shared import Scratch, Table


def _star(edges: DataFrame) -> DataFrame:
    """One large-star step and one small-star step over rows (u, v).

    Minima come from a partial aggregation and are joined back, so that a node with
    very many neighbours is a skewed join that Spark splits, not one large group.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    # every row now points from a larger to a smaller node
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
    return joined.select("e.u", "e.v").where("u <> v").distinct()


def _mark(table: Table) -> tuple:
    return tuple(table.read().agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFF))).first())


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> Table:
    """Rows (u, v): each node that has an edge, but for the smallest of its component, with that smallest node.

    ``edges`` has long columns u and v; loops and repeats are allowed, an empty table gives an empty one.
    Each round is written to the shared folder, so a lost executor costs at most one round; the number of
    rounds grows with the logarithm of the longest path.
    """
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        after = scratch.save(_star(now.read()), "star")
        now.drop()
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now
