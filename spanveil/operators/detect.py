"""Detectors over normalised text. Each gives a column array<SPAN>; ``detect_all`` puts them in the order that decides ties."""

from __future__ import annotations

import re
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PROFILES, SHIPPED, Bundle
from ..functions.dialect import Pattern
from ..functions.finditer import matches
from ..functions.folding import bind
from ..functions.validators import VALIDATORS
from ..schema import no_spans, span, with_fields
from ..workers import reach_workers

# A section begins at a line of capitals or at a numbered short line. The line feed before it is looked for, so that a suffix of a text can be searched.
CAPITAL_LINE = r"(?dUm)(?<=\n)\s*[A-ZА-ЯЁ0-9][A-ZА-ЯЁ0-9\s\.-]{2,}$"
NUMBERED_LINE = r"(?dUm)(?<=\n)\s*\d+(?:\.\d+)*\s*\.?.{0,60}$"
#: Most characters of a subject span, and how far an address window is widened.
MOST_SUBJECT, WIDEN = 2000, 40
DIGITS = {"INN": r"\d{10}", "OGRN": r"\d{13}", "KPP": r"\d{9}", "BIK": r"\d{9}", "RS": r"\d{20}", "KS": r"\d{20}"}
#: What a text must hold for a built-in pattern to match at all: a cheap search before a dear one.
_CYRILLIC = r"[\x{400}-\x{4FF}]"
GUARDS = {
    "org_pattern": _CYRILLIC,
    "role_named_pattern": _CYRILLIC,
    "in_face_pattern": _CYRILLIC,
    "subject_header_pattern": _CYRILLIC,
    "email_pattern": "@",
    "url_pattern": r"\.[A-Za-z]{2}",
    "addr_window_pattern": _CYRILLIC,
} | {f"{label.lower()}_pattern": "(?U)" + run for label, run in DIGITS.items()}
# Scores.
SCORES = {"ORG": 0.85, "FACE": 0.92, "POA": 0.97, "HEADER": 0.95, "KEYWORD": 0.7, "EMAIL": 0.95, "URL": 0.95, "INN": 0.98, "OGRN": 0.98, "KPP": 0.95, "BIK": 0.95, "RS": 0.96, "KS": 0.96, "ADDR": 0.93}


def _plain(found: Column, label: str, score: float) -> Column:
    return F.transform(found, lambda m: span(m["start"], m["end"], label, score))


def _found(text: Column, bundle: Bundle, name: str) -> Column:
    """Matches of a pattern, behind its guard if it is a built-in one."""
    pattern = bundle[name]
    built_in = pattern is not None and pattern.python in {profile["regex"][name] for profile in PROFILES.values()}
    return matches(text, pattern, guard=text.rlike(GUARDS[name]) if built_in else None)


def orgs(text: Column, bundle: Bundle) -> Column:
    return _plain(_found(text, bundle, "org_pattern"), "ORG", SCORES["ORG"])


def emails(text: Column, bundle: Bundle) -> Column:
    return _plain(_found(text, bundle, "email_pattern"), "EMAIL", SCORES["EMAIL"])


def urls(text: Column, bundle: Bundle) -> Column:
    return _plain(_found(text, bundle, "url_pattern"), "URL", SCORES["URL"])


def identifiers(text: Column, bundle: Bundle, label: str) -> Column:
    """INN, OGRN, KPP, BIK, RS or KS: matches that its validator confirms."""
    found = _found(text, bundle, f"{label.lower()}_pattern")
    return _plain(F.filter(found, lambda m: VALIDATORS[label](m["text"])), label, SCORES[label])


def roles(text: Column, bundle: Bundle) -> Column:
    """Phrases of representation, then numbers and dates of powers of attorney, each by its own span."""
    face = _plain(_found(text, bundle, "in_face_pattern"), "ROLE", SCORES["FACE"])
    pattern = bundle["role_named_pattern"]
    if pattern is None or not {"num", "date"} & set(pattern.groups):
        return face
    if pattern.python != SHIPPED["regex"]["role_named_pattern"]:
        return F.concat(face, F.transform(named_groups(pattern)(text), lambda g: span(g["start"], g["end"], "ROLE", SCORES["POA"])))
    # Groups around what stands before the number and the date: a match ends with them, so their lengths give the offsets.
    java = pattern.java
    for name in ("num", "date"):
        at = java.index(f"(?<{name}>")
        opened = java.rindex("(?:\\s*", 0, at) + 3
        java = f"{java[:opened]}({java[opened:at]}){java[at:]}"
    found = matches(text, replace(pattern, java=java), (1, 2, 3, 4), guard=text.rlike(_CYRILLIC))

    def parts(m: Column) -> Column:
        before_number, number, before_date, date = (m["groups"][k] for k in range(4))
        day = m["end"] - F.length(date)
        last = day - F.length(before_date)
        return F.array_compact(
            F.array(
                F.when(F.length(number) > 0, span(last - F.length(number), last, "ROLE", SCORES["POA"], extra="POA_NUM")),
                F.when(F.length(date) > 0, span(day, m["end"], "ROLE", SCORES["POA"], extra="POA_DATE")),
            )
        )

    return F.concat(face, F.flatten(F.transform(found, parts)))


def named_groups(pattern: Pattern):
    """Offsets of the groups num and date of any other pattern, by Python's engine, a batch at a time."""
    reach_workers()
    source, flags = pattern.python, pattern.flags
    names = [n for n in ("num", "date") if n in pattern.groups]

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        rx = re.compile(source, flags)
        return texts.map(lambda t: [{"start": m.start(n), "end": m.end(n)} for m in rx.finditer(t or "") for n in names if m[n]])

    return run


def next_section(text: Column, at: Column) -> Column:
    """The first section line that begins at ``at`` (over 0) or later, else the text's end."""
    suffix = F.substring(text, at, F.length(text))  # from the character before ``at``
    first = [F.regexp_instr(suffix, F.lit(rx)) for rx in (CAPITAL_LINE, NUMBERED_LINE)]
    near = F.least(*[F.when(p > 0, p) for p in first])
    return F.coalesce(at + near - 2, F.length(text))


def _last_gap(text: Column) -> Column:
    """The place of the last blank line, -1 if none."""
    back = F.locate("\n\n", F.reverse(text))
    return F.when(back > 0, F.length(text) - back - 1).otherwise(-1)


def _sub(text: Column, start: Column, end: Column) -> Column:
    return text.substr(start + 1, F.greatest(end - start, F.lit(0)))


def _trimmed(text: Column, start: Column, end: Column, score: float) -> Column:
    """A subject span; a longer one ends at the last blank line within the most characters, or there."""

    def cut(b: Column) -> Column:
        gap = _last_gap(b["head"])
        close = F.when(b["end"] - b["start"] <= MOST_SUBJECT, b["end"]).when(gap > 0, b["start"] + gap).otherwise(b["start"] + MOST_SUBJECT)
        return span(b["start"], close, "SUBJECT", score)

    bounds = F.struct(start.alias("start"), end.alias("end"))
    return bind(bounds, lambda b: bind(F.struct(b["start"], b["end"], _sub(text, b["start"], b["start"] + MOST_SUBJECT).alias("head")), cut))


def header_subjects(text: Column, bundle: Bundle) -> Column:
    return F.transform(_found(text, bundle, "subject_header_pattern"), lambda m: _trimmed(text, m["start"], next_section(text, m["end"]), SCORES["HEADER"]))


def keyword_subjects(text: Column, bundle: Bundle) -> Column:
    """For each keyword the paragraph of its first occurrence."""
    words = list(bundle.subject_keywords)
    if not words:
        return no_spans()

    def paragraph(p: Column) -> Column:
        gap = _last_gap(p["before"])
        start = F.when(gap < 0, 0).otherwise(gap + 2)
        close = F.locate("\n\n", p["after"])
        end = F.when(close > 0, F.length(p["before"]) + close - 1).otherwise(F.length(text))
        return _trimmed(text, start, end, SCORES["KEYWORD"])

    def places(low: Column) -> Column:
        cut = lambda word: F.substring_index(low, word, 1)
        return F.array(*[F.when(low.contains(w), F.struct(cut(w).alias("before"), low.substr(F.length(cut(w)) + 1, F.length(low)).alias("after"))) for w in words])

    return F.transform(F.array_compact(bind(F.lower(text), places)), paragraph)


def subjects(text: Column, bundle: Bundle) -> Column:
    """Sections under a header; only where there is none, paragraphs of keywords."""
    pattern = bundle["subject_header_pattern"]
    by_word = keyword_subjects(text, bundle)
    if pattern is None or pattern.never:
        return by_word
    found = header_subjects(text, bundle)
    return F.when(F.size(found) > 0, found).otherwise(by_word)


def addresses(text: Column, bundle: Bundle) -> Column:
    """Windows between two address words that hold a street or a house, widened and cut behind the next full stop or semicolon."""
    window, street, house = (bundle[f"addr_{n}_pattern"] for n in ("window", "street", "house"))
    if None in (window, street, house) or None in (street.java, house.java):
        return no_spans()

    def widened(m: Column) -> Column:
        left = F.greatest(m["start"] - WIDEN, F.lit(0))
        tail = _sub(text, m["end"], F.least(m["end"] + WIDEN, F.length(text)))
        stop = F.regexp_instr(tail, F.lit(r"(?dU)[.;](?:\s|$)"))
        right = m["end"] + F.when(stop > 0, stop).otherwise(F.length(tail))
        return F.struct(left.alias("left"), _sub(text, left, right).alias("piece"))

    def first_copy(w: Column) -> Column:
        """The place of the first equal piece of the text."""
        start = F.call_function("locate", w["piece"], text) - 1
        return span(start, start + F.length(w["piece"]), "ADDR", SCORES["ADDR"])

    found = F.filter(_found(text, bundle, "addr_window_pattern"), lambda m: m["text"].rlike(street.java) | m["text"].rlike(house.java))
    return F.transform(F.transform(found, widened), first_copy)


def regex_spans(text: Column, bundle: Bundle, include_subject: bool = True) -> list[Column]:
    """All pattern detectors, in order."""
    found = [orgs(text, bundle), roles(text, bundle)]
    if include_subject:
        found.append(subjects(text, bundle))
    found += [emails(text, bundle), urls(text, bundle)]
    found += [identifiers(text, bundle, label) for label in DIGITS]
    return [*found, addresses(text, bundle)]


def in_order(parts: list[Column]) -> Column:
    """Spans of all detectors with their order of detection; extra labels end here."""
    return F.transform(F.concat(*parts), lambda s, i: with_fields(s, ord=i, extra_label=F.lit(None).cast("string")))
