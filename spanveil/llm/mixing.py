"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

The targets fill up like water: sources share ``share`` of all words by weight, a source stops at ``most`` times its own words, and the excess goes to
the others by weight until none is above. Every document of a source then expects the same number of copies, target / words of the
source. Along the source's documents, by size, those expectations are summed up, one random offset is added, and a document is
taken once for every integer that its stretch of the sum crosses: floor or ceiling of its expectation, never more than ``most``.
As the documents stand in order of size, the words taken miss the target by no more than the source's largest document.

The prefix sum is exact and distributed (``ranks``): by source, then size, then a bucket of the id; a source or a size that holds a
third of all rows is spread over the buckets below it. Sums and sorts move narrow rows; ``copies`` joins the documents once, by a number that each gets as it is written.
Only the table of sources, one row each, meets in one task.

Defined cases: a null or empty text has size 0 (it may be taken, for no words); the null source is a source, last in order; equal
rows are interchangeable; a null doc_id sorts first, by a digest of its text; an empty table gives no rows; sources whose documents are all empty have
target 0; a very long text is one word count; further columns are kept by ``copies`` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settle
from .ranks import running_total

SALTS = 1024


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    seed: int = 17
    #: A table of sources up to this many rows is broadcast; a larger one is joined by shuffling.
    most_broadcast: int = 20_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keyed(docs: DataFrame, size: Column, *more: Column) -> DataFrame:
    source, doc_id = F.col("source").cast("string"), F.col("doc_id").cast("long")
    code = F.md5(F.coalesce(doc_id.cast("string"), F.col("text").cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        doc_id.alias("doc_id"),
        source.alias("source"),
        size.alias("size"),
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("__source"),
        (F.conv(F.substring(code, 1, 4), 16, 10).cast("int") % SALTS).alias("__salt"),
        F.when(doc_id.isNull(), code).alias("__code"),
        *more,
    )


def targets(buckets: DataFrame, options: Mix) -> DataFrame:
    """One row a source: its words, target, expected copies of a document, and offset."""
    every = Window.partitionBy()
    sources = buckets.groupBy("__source").agg(F.sum(F.col("size") * F.col("__amount")).cast("long").alias("source_size"))
    code_point = Window.orderBy(F.when(F.col("__source") == "", 1).otherwise(0), "__source")
    weight = F.element_at(F.array(*map(F.lit, options.weights)), (F.row_number().over(code_point) - 1) % len(options.weights) + 1)
    sources = sources.withColumn("__weight", weight).withColumn("__total", F.sum("source_size").over(every))
    most = F.col("source_size") * options.most
    filling = Window.orderBy(most / F.col("__weight"), "__source")
    sources = sources.withColumn("__most", most)
    sources = sources.withColumn("__full", F.coalesce(F.sum("__most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sources = sources.withColumn("__rest", F.sum("__weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    sources = sources.withColumn("__level", (F.col("__total") * options.share - F.col("__full")) / F.col("__rest"))
    open_ = F.when(F.col("__level") * F.col("__weight") <= F.col("__most"), F.col("__full"))
    first = F.min(open_).over(every)
    level = F.min(F.when(open_ == first, F.col("__level"))).over(every)
    target = F.least(F.col("__most").cast("double"), F.coalesce(level * F.col("__weight"), F.col("__most").cast("double")))
    code = F.conv(F.substring(F.md5(F.concat(F.lit(f"{options.seed}:"), F.col("__source")).cast("binary")), 1, 8), 16, 10)
    return sources.select(
        "__source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("__copies"),
        (code.cast("double") / 4294967296.0).alias("__offset"),
    )


def mix(docs: DataFrame, options: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target and taken words of each document, its source and its copies."""
    placed = taken(settle(keyed(docs, words(F.col("text")))), options)
    return placed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def taken(sized: DataFrame, options: Mix) -> DataFrame:
    """The rows of ``keyed`` with source_size, target and copies."""
    buckets = settle(sized.groupBy("__source", "size", "__salt").agg(F.count(F.lit(1)).alias("__amount")))
    known = _checked(settle(targets(buckets, options)), options)
    placed = running_total(sized, ["__source"], ["size", "__salt"], [F.col("doc_id"), F.col("__code")], into="__place", totals=buckets)
    crossed = lambda place: F.floor(place.cast("double") * F.col("__copies") + F.col("__offset"))
    return placed.join(known, "__source").withColumn("copies", (crossed(F.col("__place") + 1) - crossed(F.col("__place"))).cast("long"))


def _checked(sources: DataFrame, options: Mix) -> DataFrame:
    """A settled table of sources, to be broadcast if it has been counted to be small."""
    return F.broadcast(sources) if sources.count() <= options.most_broadcast else sources


def copies(docs: DataFrame, options: Mix = Mix()) -> DataFrame:
    """The mixed documents: every row as often as it is taken, with its own columns."""
    names = [f"`{c}`" for c in docs.columns]
    held = settle(docs.select(*names, words(F.col("text")).alias("__words"), F.monotonically_increasing_id().alias("__row")))
    mixed = taken(keyed(held, F.col("__words"), F.col("__row")), options).where("copies > 0").select("__row", F.col("copies").cast("int").alias("__times"))
    # There is a row for each document, so it is merged at any size and never broadcast.
    return held.join(settle(mixed).hint("merge"), "__row").withColumn("__one", F.explode(F.array_repeat(F.lit(0), F.col("__times")))).select(*names)


def oracle(options: Mix = Mix()) -> str:
    """The same mix as DuckDB SQL over ``documents``."""
    weights = ", ".join(map(str, options.weights))
    pattern = WORD.replace("'", "''")
    return f"""
    WITH sized AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{pattern}')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS code,
            CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS skey
        FROM documents),
    sums AS (SELECT skey, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
    weighed AS (
        SELECT *, ([{weights}])[((row_number() OVER (ORDER BY skey = '', skey) - 1) % {len(options.weights)} + 1)::INT] AS weight,
            source_size * {options.most} AS most, (sum(source_size) OVER ())::BIGINT AS total
        FROM sums),
    filled AS (
        SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled_up,
            (sum(weight) OVER (ORDER BY most / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest
        FROM weighed),
    levels AS (SELECT *, (total * {options.share}::DOUBLE - filled_up) / rest AS level FROM filled),
    water AS (SELECT min_by(level, filled_up) AS level FROM levels WHERE level * weight <= most),
    targets AS (
        SELECT skey, source_size, least(most::DOUBLE, coalesce((SELECT level FROM water) * weight, most::DOUBLE)) AS target,
            (('0x' || substr(md5('{options.seed}:' || skey), 1, 8))::BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS start
        FROM levels),
    placed AS (
        SELECT doc_id, source, size, source_size, target, start, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS expected,
            row_number() OVER (PARTITION BY skey ORDER BY size, ('0x' || substr(code, 1, 4))::INT % {SALTS}, doc_id NULLS FIRST, CASE WHEN doc_id IS NULL THEN code END) AS place
        FROM sized JOIN targets USING (skey)),
    taken AS (SELECT *, (floor(place::DOUBLE * expected + start) - floor((place - 1)::DOUBLE * expected + start))::BIGINT AS copies FROM placed)
    SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM taken"""
