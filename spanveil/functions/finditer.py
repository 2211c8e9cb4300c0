"""All matches of a pattern with their offsets, from built-in functions.

A text cut at a pattern's matches has one piece more than there are matches, so lengths of pieces and matches give every offset. A match must
not be empty (``dialect.compile_pattern`` sees to that). Patterns that Java can't express run in an Arrow-fed Python function instead.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..workers import reach_workers
from .dialect import Pattern
from .folding import bind, fold

MATCH = "struct<start:int,end:int,text:string,groups:array<string>>"


def finditer(text: Column, java: str, groups: Sequence[int] = ()) -> Column:
    """array<struct<start, end, text, groups>>: groups holds the texts of the asked groups, empty where a group took no part.

    A text without a match is searched once; one with matches is searched once more for the pieces between them, and once for each group.
    """
    rx, none = F.lit(java), F.array().cast(f"array<{MATCH}>")

    def placed(found: Column) -> Column:
        pieces = F.zip_with(F.split(text, java, -1), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("text"), F.array().cast("array<string>").alias("groups")))
        pieces = F.filter(pieces, lambda p: p["text"].isNotNull())  # behind the last match there is one piece more
        for group in groups:
            own = F.regexp_extract_all(text, rx, F.lit(group))
            pieces = F.zip_with(pieces, own, lambda p, g: F.struct(p["gap"].alias("gap"), p["text"].alias("text"), F.array_append(p["groups"], g).alias("groups")))

        def step(at: Column, out: Column, p: Column) -> tuple[Column, Column]:
            start = at + p["gap"]
            end = start + F.length(p["text"])
            return end, F.array_append(out, F.struct(start.alias("start"), end.alias("end"), p["text"].alias("text"), p["groups"].alias("groups")))

        return fold(pieces, F.lit(0), MATCH, step, lambda _, out: out)

    return bind(F.regexp_extract_all(text, rx, F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def python_finditer(pattern: Pattern, groups: Sequence[int] = ()):
    """The same with Python's own engine, a batch at a time."""
    reach_workers()
    source, flags, wanted = pattern.python, pattern.flags, tuple(groups)

    @F.pandas_udf(f"array<{MATCH}>")
    def run(texts: pd.Series) -> pd.Series:
        rx = re.compile(source, flags)
        one = lambda t: [{"start": m.start(), "end": m.end(), "text": m[0], "groups": [m[g] or "" for g in wanted]} for m in rx.finditer(t)] if t is not None else []
        return texts.map(one)

    return run


def matches(text: Column, pattern: Pattern | None, groups: Sequence[int] = (), guard: Column | None = None) -> Column:
    """Matches of a pattern: none of a pattern that is off, and none where the cheap ``guard`` already rules them out."""
    none = F.array().cast(f"array<{MATCH}>")
    if pattern is None or pattern.never:
        return none
    if pattern.java is None:
        return python_finditer(pattern, groups)(text)
    found = finditer(text, pattern.java, groups)
    return found if guard is None else F.when(guard, found).otherwise(none)
