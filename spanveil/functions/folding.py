"""Folds over arrays whose cost grows in proportion to their length.

A fold that appends to an array copies it at each step. Here an array is cut into chunks; a chunk's results are gathered in an array of their
own, and the arrays of all chunks are joined at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 64


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunks(items: Column) -> Column:
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda k: F.slice(x, k * CHUNK + 1, CHUNK))
    return bind(items, lambda x: F.when(F.size(x) > 0, cut(x)).otherwise(F.array(F.slice(x, 1, 0))))


def fold(
    items: Column,
    state: Column,
    kind: str,
    step: Callable[[Column, Column, Column], tuple[Column, Column]],
    finish: Callable[[Column, Column], Column],
    enter: Callable[[Column, Column], Column] | None = None,
) -> Column:
    """``finish`` of the last state and an array<kind> of all that was gathered.

    step: state, what this chunk has gathered, item -> the new state and what is gathered then. enter: the state with which a chunk begins, of the state so far and the chunk.
    """
    empty = F.array().cast(f"array<{kind}>")

    def one(acc: Column, item: Column) -> Column:
        following, out = step(acc["state"], acc["out"], item)
        return F.struct(following.alias("state"), out.alias("out"))

    def chunk(acc: Column, own: Column) -> Column:
        first = enter(acc["state"], own) if enter else acc["state"]
        done = F.aggregate(own, F.struct(first.alias("state"), empty.alias("out")), one)
        return bind(F.struct(done.alias("d"), acc["parts"].alias("p")), lambda x: F.struct(x["d"]["state"].alias("state"), F.array_append(x["p"], x["d"]["out"]).alias("parts")))

    begin = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("parts"))
    return F.aggregate(chunks(items), begin, chunk, lambda acc: finish(acc["state"], F.flatten(acc["parts"])))
