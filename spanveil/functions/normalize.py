"""Normalised text and the way back to offsets of the given text.

CRLF becomes LF, hyphenated words are joined across lines, quotation marks and dashes become plain ones. Only the first two delete
characters, so a sparse list of deletions maps every offset back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .finditer import MATCH, finditer
from .folding import bind, fold

# Characters that are replaced, one for one.
QUOTES, DASHES = "«»”„", "—–−"
#: What is deleted: a hyphen and line end between letters, and the CR of other CRLF.
DELETED = r"(?d)(?<=\p{L})-\r?\n(?=\p{L})|\r(?=\n)"


def _may_shrink(text: Column) -> Column:
    """A cheap necessary condition for any deletion."""
    return text.contains("-\n") | text.contains("\r\n")


def normalized(text: Column) -> Column:
    joined = F.when(_may_shrink(text), F.regexp_replace(text, DELETED, "")).otherwise(text)
    plain = F.translate(joined, QUOTES + DASHES, '"' * len(QUOTES) + "-" * len(DASHES))
    return F.when(text.rlike(f"[{QUOTES}{DASHES}]"), plain).otherwise(joined)


EDIT = "struct<pos:int,deleted:int,total:int>"


def edits(text: Column) -> Column:
    """array<struct<pos, deleted, total>>: how many characters went before which offset of the normalised text, and how many up to there."""
    found = F.when(_may_shrink(text), finditer(text, DELETED)).otherwise(F.array().cast(f"array<{MATCH}>"))

    def step(gone: Column, out: Column, m: Column) -> tuple[Column, Column]:
        size = m["end"] - m["start"]
        return gone + size, F.array_append(out, F.struct((m["start"] - gone).alias("pos"), size.alias("deleted"), (gone + size).alias("total")))

    return fold(found, F.lit(0), EDIT, step, lambda _, out: out)


def original(offset: Column, deletions: Column) -> Column:
    """The offset in the given text of a character of the normalised text: the last deletion at or before it is found by halving."""

    def search(x: Column) -> Column:
        n, steps = F.size(x["e"]), F.ceil(F.log2(F.size(x["e"]) + 1)).cast("int")

        def halve(acc: Column, _: Column) -> Column:
            middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
            before = F.get(x["e"], middle)["pos"] <= x["at"]
            open_ = acc["low"] < acc["high"]
            return F.struct(F.when(open_ & before, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~before, middle).otherwise(acc["high"]).alias("high"))

        low = F.aggregate(F.sequence(F.lit(0), steps), F.struct(F.lit(0).alias("low"), n.alias("high")), halve, lambda acc: acc["low"])
        return x["at"] + F.when(n > 0, F.coalesce(F.get(x["e"], low - 1)["total"], F.lit(0))).otherwise(0)

    return bind(F.struct(offset.alias("at"), deletions.alias("e")), search)


def _moved(s: Column, start: Column, end: Column) -> Column:
    return s.withField("start", start).withField("end", end)


def map_spans(spans: Column, deletions: Column, moved: Callable[[Column, Column, Column], Column] = _moved) -> Column:
    """Spans of the normalised text with offsets of the given one. moved: a span with another start and end."""
    both = F.struct(spans.alias("s"), deletions.alias("e"))
    return bind(both, lambda x: F.transform(x["s"], lambda s: moved(s, original(s["start"], x["e"]), original(s["end"] - 1, x["e"]) + 1)))
