"""Spark-native finding and masking of entities in large text collections."""

from .config import Bundle, load_patterns
from .plans.pipeline import Pipeline, detect, redact, redact_text
from .schema import MaskStyle, Options

__all__ = ["Bundle", "MaskStyle", "Options", "Pipeline", "detect", "load_patterns", "redact", "redact_text"]
