"""Connected components by alternating stars.

Edges are rewritten until they form stars around the smallest node of each
component: a large star links a node's larger neighbours to its smallest
neighbour, a small star its smaller ones. Both are an aggregate and a join on
the node, so a node with very many neighbours is no group in one task, and the
number of rounds grows with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reportlake.session import scratch_path


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends here."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(``u``, ``v``): every linked node with the smallest node of its component;
    the smallest nodes themselves have no row. ``edges`` are pairs (u, v) of
    integers in any order; loops, nulls and repeated edges are ignored."""
    edges = staged(spark, _small_star(edges.where("u <> v").distinct()), "stars")
    before = _digest(edges)
    while before[0]:
        edges = staged(spark, _small_star(_large_star(edges)), "stars")
        now = _digest(edges)
        if now == before:
            break
        before = now
    return edges
