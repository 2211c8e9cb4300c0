"""The SQL surface: validators, ``redact(text)``, ``redact_as(text, style)`` and the table function ``detect_spans(text)``.

Each is the expression of the DataFrame API as SQL text (``sqltext``): one implementation, which the optimizer inlines and which stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..config import PROFILES, Bundle, bundle
from ..operators.mask import masked
from ..plans.pipeline import spans_of_text
from ..schema import MaskStyle, Options
from . import validators
from .folding import bind
from .sqltext import sql_text


def styled(text: Column, style: Column, held: Bundle, salt: str) -> Column:
    """The text with masks of a style by its name; an unknown name is an error."""

    def by_style(spans: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for known in MaskStyle:
            out = out.when(style == known.value, masked(text, spans, Options(known), salt=salt)["redacted"])
        return out.otherwise(F.raise_error(F.concat(F.lit("unknown mask style: "), F.coalesce(style, F.lit("null")))).cast("string"))

    return bind(spans_of_text(text, held), by_style)


NAMES = ("validate", "redact", "redact_as", "detect_spans")


def register(spark: SparkSession, patterns: Bundle | None = None, salt: str = "", names: Sequence[str] = NAMES) -> None:
    """validate_*, redact(text), redact_as(text, style) and detect_spans(text) for SQL of this session, or those of them that are named.

    Spark analyses each when it is registered, which takes some seconds. Patterns that need Python workers can't be registered.
    """
    held = patterns or bundle(PROFILES["shipped"])
    text, style = F.col("text"), F.col("style")
    spans = spans_of_text(text, held)
    if "validate" in names:
        validators.register(spark)
    if "redact" in names:
        plain = sql_text(masked(text, spans, Options(), salt=salt)["redacted"])
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION redact(text STRING) RETURNS STRING RETURN {plain}")
    if "redact_as" in names:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION redact_as(text STRING, style STRING) RETURNS STRING RETURN {sql_text(styled(text, style, held, salt))}")
    if "detect_spans" in names:
        value = lambda s: text.substr(s["start"] + 1, s["end"] - s["start"])
        found = sql_text(F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "label", "score")], value(s).alias("value"))))
        columns = "start INT, `end` INT, label STRING, score DOUBLE, value STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION detect_spans(text STRING) RETURNS TABLE ({columns}) RETURN SELECT s.start, s.`end`, s.label, s.score, s.value FROM (SELECT explode({found}) AS s)")
