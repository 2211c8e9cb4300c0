"""Distributed running totals, so that not even one key with a third of all rows meets in a task.

Rows that are equal in keys, levels and order are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def salt(*columns: Column, buckets: int = 1024) -> Column:
    """An even bucket number for any values, nulls included."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def bases(totals: DataFrame, keys: Sequence[str], levels: Sequence[str], amount: str) -> DataFrame:
    """Of each bucket, the sum of ``amount`` over the earlier buckets of its keys. totals: keys, levels and amount, one row a bucket."""
    finest = [*keys, *levels]
    sums = totals
    base: DataFrame | None = None
    for depth in range(len(levels)):
        outer, own = [*keys, *levels[:depth]], [*keys, *levels[: depth + 1]]
        level = sums if len(own) == len(finest) else sums.groupBy(*own).agg(F.sum(amount).alias(amount))
        earlier = Window.partitionBy(*outer).orderBy(levels[depth]).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(amount).over(earlier), F.lit(0)).cast("long")
        level = level.select(*own, before.alias("__own"), *([c for c in level.columns if c not in {*own, amount}] if len(own) == len(finest) else []))
        base = level.withColumnRenamed("__own", "__base") if base is None else level.join(base, outer).withColumn("__base", F.col("__base") + F.col("__own")).drop("__own")
    return base


def running_total(df: DataFrame, keys: Sequence[str], levels: Sequence[str], order: Sequence[Column], amount: Column | None = None, into: str = "before", totals: DataFrame | None = None) -> DataFrame:
    """Add ``into``: the sum of ``amount`` (rows if None) over all earlier rows of the same keys, by the level columns and then ``order``.

    Totals of the buckets (keys and levels) are pre-aggregated and summed level by level; a level holds few values below the one
    before it. Only the rows of one bucket are put in order together. Keys and levels hold no nulls. ``totals`` may bring the bucket
    totals with further columns of the keys; those join the rows.
    """
    data = df.withColumn("__amount", (amount if amount is not None else F.lit(1)).cast("long"))
    if totals is None:
        totals = data.groupBy(*keys, *levels).agg(F.sum("__amount").alias("__amount"))
    inside = Window.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    data = data.withColumn("__inside", F.coalesce(F.sum("__amount").over(inside), F.lit(0)).cast("long"))
    data = data.join(bases(totals, keys, levels, "__amount"), [*keys, *levels])
    return data.withColumn(into, F.col("__base") + F.col("__inside")).drop("__amount", "__inside", "__base")
