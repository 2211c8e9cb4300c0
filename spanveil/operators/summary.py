"""Counts of what was masked: by label, by document, over all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def logs(redacted: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a masked span.

    The outer generator keeps the optimizer from repeating the whole detection in a filter below it.
    """
    return redacted.select(key, F.inline_outer("logs")).where(F.col("label").isNotNull())


def per_document(redacted: DataFrame, key: str = "doc_id") -> DataFrame:
    """status, replacements by label and masked characters of each document; a document counts its own array, without a shuffle."""
    labels = F.transform("logs", lambda e: e["label"])
    distinct = F.array_sort(F.array_distinct(labels))
    counts = F.transform(distinct, lambda d: F.size(F.filter(labels, lambda x: x == d)).cast("bigint"))
    masked = F.aggregate("logs", F.lit(0).cast("bigint"), lambda acc, e: acc + (e["end"] - e["start"]))
    ok = F.col("redacted").isNotNull()
    return redacted.select(
        key,
        F.when(ok, "ok").otherwise("skipped").alias("status"),
        F.when(ok, F.map_from_arrays(distinct, counts)).alias("replacements"),
        F.when(ok, masked).alias("chars_masked"),
    )


def totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.coalesce(F.sum("chars_masked"), F.lit(0)).cast("bigint").alias("chars_masked"),
    )


def by_label(redacted: DataFrame) -> DataFrame:
    """Masked spans of each label; partial counts are made before the shuffle."""
    return redacted.select(F.explode_outer("logs.label").alias("label")).where(F.col("label").isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
