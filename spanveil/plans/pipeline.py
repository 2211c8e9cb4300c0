"""detect, redact and the Pipeline: one narrow plan from text to masked text, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Bundle, load_patterns
from ..functions.folding import bind
from ..functions.normalize import edits, map_spans, normalized
from ..operators import names as people
from ..operators.detect import in_order, regex_spans
from ..operators.mask import masked
from ..operators.merge import merged, scored
from ..operators.structured import structured_spans
from ..schema import Options, with_fields


def detected(norm: Column, bundle: Bundle, options: Options = Options(), models: dict | None = None) -> Column:
    """All spans of normalised text in the order of detection: recognisers, names, patterns. Models must be there, unless ``models`` says ``required=False``."""
    parts: list[Column] = []
    if "structured" in options.recognizers:
        parts += structured_spans(norm, min_score=options.min_score)
    if "ner" in options.recognizers:
        parts += people.name_spans(norm, **({"required": True} | (models or {})))
    if "regex" in options.recognizers:
        parts += regex_spans(norm, bundle, options.include_subject)
    return in_order(parts)


def detect(df: DataFrame, bundle: Bundle | None = None, options: Options = Options(), text: str = "text", models: dict | None = None) -> DataFrame:
    """df with a column ``spans``: merged, with offsets of ``text``, of the least score or more."""
    bundle = bundle or load_patterns()
    content = F.coalesce(F.col(text), F.lit(""))
    staged = df.withColumn("__norm", normalized(content))
    staged = staged.withColumn("__found", merged(detected(F.col("__norm"), bundle, options, models)))
    if options.offset_mode == "exact":
        staged = staged.withColumn("__edits", edits(content)).withColumn("__found", map_spans(F.col("__found"), F.col("__edits"))).drop("__edits")
    return staged.withColumn("spans", merged(scored(F.col("__found"), options.min_score))).drop("__norm", "__found")


def redact(df: DataFrame, bundle: Bundle | None = None, options: Options = Options(), text: str = "text", key: str | None = None, models: dict | None = None) -> DataFrame:
    """df with ``redacted`` and ``logs``; a null text is null again, with no logs."""
    found = detect(df, bundle, options, text, models)
    done = masked(F.col(text), F.col("spans"), options, F.col(key) if key else None)
    return found.withColumn("__done", done).withColumn("redacted", F.col("__done.redacted")).withColumn("logs", F.col("__done.logs")).drop("__done", "spans")


def spans_of_text(text: Column, bundle: Bundle, options: Options = Options()) -> Column:
    """The spans that ``detect`` gives, as one expression of a text column."""
    content = F.coalesce(text, F.lit(""))
    spans = bind(normalized(content), lambda norm: merged(detected(norm, bundle, options)))
    if options.offset_mode == "exact":
        spans = map_spans(spans, edits(content), _moved)
    return merged(scored(spans, options.min_score))


def _moved(s: Column, start: Column, end: Column) -> Column:
    return with_fields(s, start=start, end=end)


def redact_text(text: Column, bundle: Bundle | None = None, options: Options = Options(), key: Column | None = None) -> Column:
    """struct<redacted, logs> of a text column, for use inside other expressions. Models and patterns for Python workers need ``redact``."""
    return masked(text, spans_of_text(text, bundle or load_patterns(), options), options, key)


class Pipeline:
    """Options and patterns, kept together."""

    def __init__(self, options: Options = Options(), patterns: str | None = None, profile: str = "shipped", models: dict | None = None):
        self.options, self.profile, self.models = options, profile, models
        self.bundle = load_patterns(patterns, profile)

    def reload(self, patterns: str | None = None) -> None:
        """New patterns for later plans; plans that are made keep theirs."""
        self.bundle = load_patterns(patterns, self.profile)

    def detect(self, df: DataFrame, text: str = "text") -> DataFrame:
        return detect(df, self.bundle, self.options, text, self.models)

    def redact(self, df: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
        return redact(df, self.bundle, self.options, text, key, self.models)

    def process_text(self, spark, text: str) -> tuple[str, list[dict]]:
        """One text; for trying things out."""
        row = self.redact(spark.createDataFrame([(text,)], "text string")).first()
        return row["redacted"], [r.asDict() for r in row["logs"]]
