"""Overlapping spans become one: a sort and a fold over each document's own array, without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.folding import fold
from ..schema import SOURCE_PRIORITY, SPAN


def overlap(a: Column, b: Column) -> Column:
    """Spans that only touch do not overlap."""
    return (a["end"] > b["start"]) & (b["end"] > a["start"])


def similar(a: Column, b: Column, least: float = 0.5) -> Column:
    """One holds the other, or their common part is at least that share of their union."""
    held = ((a["start"] <= b["start"]) & (a["end"] >= b["end"])) | ((b["start"] <= a["start"]) & (b["end"] >= a["end"]))
    common = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    union = a["end"] - a["start"] + b["end"] - b["start"] - common
    return held | ((common > 0) & (common >= union * least))


def priority(source: Column) -> Column:
    known = list(SOURCE_PRIORITY.items())
    return reduce(lambda acc, kv: acc.when(source == kv[0], kv[1]), known[1:], F.when(source == known[0][0], known[0][1])).otherwise(0)


def takes_over(new: Column, old: Column) -> Column:
    """Whether the new span's label wins: score, then source, then length; the old one keeps a full tie."""
    apart = F.abs(new["score"] - old["score"]) > 1e-9
    rank = priority(new["source"]) - priority(old["source"])
    longer = new["end"] - new["start"] > old["end"] - old["start"]
    return F.when(apart, new["score"] > old["score"]).when(rank != 0, rank > 0).otherwise(longer)


def merged(spans: Column) -> Column:
    """Disjoint spans in order, with union bounds and the winner's label, score and source."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["ord"].alias("c"), s.alias("s")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["s"])
    def joined(now: Column, s: Column) -> Column:
        wins = takes_over(s, now)
        pair = ((now["label"] == "ROLE") & (s["label"] == "PERSON")) | ((now["label"] == "PERSON") & (s["label"] == "ROLE"))
        either = lambda f: F.when(wins, s[f]).otherwise(now[f]).alias(f)
        return F.struct(
            F.least(now["start"], s["start"]).alias("start"),
            F.greatest(now["end"], s["end"]).alias("end"),
            *[either(f) for f in ("label", "score", "source")],
            F.when(pair, "ROLE+PERSON").cast("string").alias("labels_joined"),
            F.lit(None).cast("string").alias("extra_label"),
            now["ord"].alias("ord"),
        )

    def step(now: Column, done: Column, s: Column) -> tuple[Column, Column]:
        meets = now.isNotNull() & overlap(now, s)
        closed = F.when(meets | now.isNull(), done).otherwise(F.array_append(done, now))
        return F.when(meets, joined(now, s)).otherwise(s).cast(SPAN), closed

    last = lambda now, done: F.when(now.isNull(), done).otherwise(F.array_append(done, now))
    return fold(ordered, F.lit(None).cast(SPAN), SPAN, step, last)


def scored(spans: Column, least: float) -> Column:
    """Spans of at least that score. It goes after merging: a weak span may widen a strong one but not stand alone."""
    return F.filter(spans, lambda s: s["score"] >= least)
