"""Connected components of a link table by alternating large and small stars.

Every round relinks each node to the smallest node it knows: the large star moves the larger neighbours of a
node, the small star its smaller ones. It ends with every node linked to the smallest of its component.
Minima combine before they are shuffled and the joins have no per-node grouping above them, so Spark can
split a node with very many links. Tables between rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def star(edges: DataFrame) -> DataFrame:
    """Both star steps on links (a, b) with b < a."""
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.filter("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node that has a link to another one; ``links`` has two columns of one type."""
    x, y = (F.col(c) for c in links.columns)
    edges = stored(links.filter(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), name)
    seen = signature(edges)
    while seen[0]:
        edges = stored(star(edges), name)
        now = signature(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()


def signature(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
