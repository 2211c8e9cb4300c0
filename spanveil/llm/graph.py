"""Connected components by alternating stars, as Spark joins over tables in the shared folder.

Each round links every node's neighbours to the smallest node near it (first the larger ones, then the smaller ones). Rounds end when nothing
changes; then each node hangs on its component's smallest node. Minima are pre-aggregated, and the joins are plain equi-joins that
adaptive execution splits where a node has very many links. Nothing but a count and a checksum of the links reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and root (the smallest node of its component), for nodes with links to others; a, b: long columns without nulls."""
    edges = settle(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    sign = _sign(edges)
    while sign[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        large = settle(large, sign[0])
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        following = settle(small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct(), sign[0])
        discard(edges)
        discard(large)
        edges, was = following, sign
        sign = _sign(edges)
        if sign == was:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
