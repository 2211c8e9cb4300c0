"""Recognisers of identifiers written with separators, and the anonymiser of contacts.

A recogniser is a row of a table: label, pattern, base score, validator. A match that its validator confirms has
score 1, one that it does not confirm goes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings, load_settings
from ..functions.dialect import compile_pattern
from ..functions.finditer import matches
from ..functions.validators import VALIDATORS
from ..schema import CONTACTS, STRUCTURED, span


@dataclass(frozen=True)
class Recogniser:
    label: str
    pattern: str
    score: float
    validator: str | None = None
    source: str = STRUCTURED


def _run(digits: str) -> str:
    return rf"(?<!\d){digits}(?!\d)"


# The recognisers of identifiers.
IDENTIFIERS = (
    Recogniser("INN", _run(r"(?:\d[\s-]?){10}(?:\d[\s-]?){0,2}"), 0.7, "INN"),
    Recogniser("OGRN", _run(r"(?:\d[\s-]?){13}"), 0.7, "OGRN"),
    Recogniser("KPP", _run(r"(?:\d[\s-]?){9}"), 0.6, "KPP"),
    Recogniser("BIK", _run(r"(?:\d[\s-]?){9}"), 0.6, "BIK"),
    Recogniser("RS", _run(r"(?:\d[\s-]?){20}"), 0.55, "RS"),
    Recogniser("KS", _run(r"(?:\d[\s-]?){20}"), 0.55, "KS"),
)
#: Our own patterns for contacts; a lone run of digits is no telephone number.
EMAIL = Recogniser("EMAIL_ADDRESS", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 1.0, source=CONTACTS)
PHONE = Recogniser("PHONE_NUMBER", r"(?<![\d.])(?:\+\d{1,3}|8)[ -]?\(?\d{3}\)?[ -]?\d{3}[ -]?\d{2}[ -]?\d{2}(?!\d)", 0.75, source=CONTACTS)
# The tags of contacts.
TAGS = {"EMAIL_ADDRESS": "[[ENTITY:EMAIL]]", "PHONE_NUMBER": "[[ENTITY:PHONE]]"}


def recognisers(settings: Settings | None = None) -> tuple[Recogniser, ...]:
    settings = settings or load_settings()
    contacts = [r for r, on in ((EMAIL, settings.enable_email_recognizer), (PHONE, settings.enable_phone_recognizer)) if on]
    return (*IDENTIFIERS, *contacts)


def recognised(text: Column, one: Recogniser) -> Column:
    guard = text.contains("@") if one is EMAIL else text.rlike(r"[0-9]")
    found = matches(text, compile_pattern(one.label, one.pattern, ["U"]), guard=guard)
    score = one.score
    if one.validator:
        found, score = F.filter(found, lambda m: VALIDATORS[one.validator](m["text"])), 1.0
    return F.transform(found, lambda m: span(m["start"], m["end"], one.label, score, one.source))


def structured_spans(text: Column, settings: Settings | None = None, min_score: float = 0.5) -> list[Column]:
    return [F.filter(recognised(text, r), lambda s: s["score"] >= min_score) for r in recognisers(settings)]


def anonymize_contacts(df: DataFrame, style: str | None = None, text: str = "text", min_score: float = 0.5, settings: Settings | None = None) -> DataFrame:
    """``text`` with e-mail addresses and telephone numbers replaced: tag, mask (all asterisks) or hash (whole SHA-256)."""
    settings = settings or load_settings()
    style = (style or settings.mask_style or "tag").lower()
    out = F.col(text)
    contacts = [r for r in recognisers(settings) if r.source == CONTACTS and r.score >= min_score]
    patterns = [compile_pattern(r.label, r.pattern, ["U"]).java for r in contacts]
    if style in ("mask", "hash"):
        return df.withColumn(text, _rewritten(out, patterns, style))
    for one, java in zip(contacts, patterns, strict=True):
        out = F.regexp_replace(out, java, TAGS[one.label].replace("[", r"\[").replace("$", r"\$"))
    return df.withColumn(text, out)


def _rewritten(text: Column, patterns: list[str], style: str) -> Column:
    """Matches of the first pattern, and between them those of the others: what has been replaced is not searched, as the digits of a hash may look like a telephone number."""
    if not patterns:
        return text
    java, *others = patterns
    pieces = F.split(text, java, -1)
    if others:
        pieces = F.transform(pieces, lambda p: _rewritten(p, others, style))
    found = F.regexp_extract_all(text, F.lit(java), F.lit(0))
    new = F.transform(found, lambda m: F.repeat(F.lit("*"), F.length(m)) if style == "mask" else F.sha2(m.cast("binary"), 256))
    return F.array_join(F.zip_with(pieces, new, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
