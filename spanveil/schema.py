"""Spans, labels, sources and options."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The canonical span. Offsets count code points, ends are exclusive; ord is the order of detection, which decides ties.
SPAN = "struct<start:int,end:int,label:string,score:double,source:string,labels_joined:string,extra_label:string,ord:int>"
SPANS = f"array<{SPAN}>"

# Labels of the pattern detectors, sources and their priority.
LABELS = ("ORG", "ROLE", "SUBJECT", "EMAIL", "URL", "INN", "OGRN", "KPP", "BIK", "RS", "KS", "ADDR")
REGEX, STRUCTURED, NAMES, CONTACTS = "Regex", "Presidio Custom", "Natasha", "Presidio Default"
SOURCE_PRIORITY = {REGEX: 3, STRUCTURED: 2, NAMES: 1, CONTACTS: 0}


class MaskStyle(str, Enum):
    TAG = "tag"
    HASH = "hash"
    RANDOM = "random"
    ASTERISKS = "asterisks"


@dataclass(frozen=True)
class Options:
    mask_style: MaskStyle = MaskStyle.TAG
    keep_length: bool = False
    min_score: float = 0.5
    include_subject: bool = True
    salt_env: str = "REDACT_SALT"
    #: exact: offsets point into the given text; compat: offsets of the normalised text are used as they are.
    offset_mode: str = "exact"
    #: Which of "structured", "ner" and "regex" detect, in this order.
    recognizers: tuple[str, ...] = ("regex",)


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, label: Column | str, score: float | Column, source: str = REGEX, extra: str | None = None) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    score = score if isinstance(score, Column) else F.lit(float(score))
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        label.alias("label"),
        score.alias("score"),
        F.lit(source).alias("source"),
        F.lit(None).cast("string").alias("labels_joined"),
        F.lit(extra).cast("string").alias("extra_label"),
        F.lit(0).alias("ord"),
    )


def with_fields(one: Column, **new: Column) -> Column:
    """A span with some fields of other values."""
    names = [f.split(":")[0] for f in SPAN[len("struct<") : -1].split(",")]
    return F.struct(*[new.get(n, one[n]).alias(n) for n in names])
