"""URL filter: a weighted vocabulary found by an Aho-Corasick automaton, after rules of hosts and paths.

Every term of the vocabulary is looked for in the URL with A-Z lowered, in one pass; a hit counts only where the characters beside it are not letters
or digits. A strict term has the weight of the threshold and rejects alone, soft terms weigh less and reject when several distinct ones meet.
Rules go first: a rule fits its host, all subdomains, and paths that start with its path; the longest one that fits decides.

Row by row, no shuffle; the vocabulary and rules are parameters that travel with the task.

Defined cases: a null URL or one without ``://`` has empty host and path; a null URL has no hits and is allowed; a very long URL is read whole, once; of
rules that are equally long the first one decides; repeated rows stay repeated; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The terms of the vocabulary. A strict term rejects alone.
STRICT = ("casino", "casinos", "porn", "porno", "xxx", "viagra", "cialis", "escort", "escorts", "spam", "warez", "malware", "phishing")
SOFT = ("adult", "bet", "bets", "betting", "bonus", "cheap", "crack", "deal", "discount", "dating", "farm", "free", "gamble", "jackpot", "keygen", "loan", "loans", "lottery", "nude", "offer", "payday", "pharmacy", "pill", "pills", "poker", "prize", "replica", "sex", "slots", "torrent", "win", "winner")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    #: Distinct soft terms that reject together.
    several: int = 2

    def weights(self) -> dict[str, int]:
        return {t: 1 for t in self.soft} | {t: self.several for t in self.strict}


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda group: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


class Judge:
    """One worker's automaton and rules."""

    def __init__(self, vocabulary: Vocabulary, rules: Sequence[Rule]):
        import ahocorasick

        self.several = vocabulary.several
        self.automaton = ahocorasick.Automaton()
        for term, weight in vocabulary.weights().items():
            self.automaton.add_word(term, (term, weight))
        if vocabulary.weights():
            self.automaton.make_automaton()
        self.empty = not vocabulary.weights()
        self.depth = max((r.host.count(".") + 1 for r in rules), default=1)  # a host may have very many labels
        self.rules: dict[str, list[Rule]] = {}
        for rule in rules:
            self.rules.setdefault(rule.host, []).append(rule)

    def hits(self, url: str) -> dict[str, int]:
        if self.empty:
            return {}
        found = {}
        word = lambda c: c.isascii() and c.isalnum()
        for last, (term, weight) in self.automaton.iter(url):
            first = last - len(term) + 1
            if not (first and word(url[first - 1])) and not (last + 1 < len(url) and word(url[last + 1])):
                found[term] = weight
        return found

    def rule(self, host: str, path: str) -> Rule | None:
        best = None
        labels = host.rsplit(".", self.depth)[-self.depth :]
        for at in range(len(labels)):
            for rule in self.rules.get(".".join(labels[at:]), ()):
                if path.startswith(rule.path) and (best is None or len(rule.text) > len(best.text)):
                    best = rule
        return best


JUDGED = "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_hits long, terms string"
_TO_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}


def judge(pages: DataFrame, rules: Sequence[Rule] = (), vocabulary: Vocabulary = Vocabulary(), key: str = "page_id", url: str = "url") -> DataFrame:
    """A verdict for each URL, with its rule (null if none fits) and the counts of distinct terms."""
    host, path = host_and_path(F.col(url).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Judge(vocabulary, rules)
        for batch in slices(batches, "url"):
            rows = []
            for page_id, text, host, path in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rule = by.rule(host, path)
                hits = by.hits((text or "").translate(_TO_LOWER))
                strict = sum(w >= by.several for w in hits.values())
                verdict = rule.verdict if rule else "block" if sum(hits.values()) >= by.several else "allow"
                rows.append((page_id, host, path, rule.text if rule else None, verdict, strict, len(hits) - strict, ",".join(sorted(hits))))
            kinds = [pa.int64() if x.endswith("long") else pa.string() for x in JUDGED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in JUDGED.split(", ")])

    return map_arrow(pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), host.alias("host"), path.alias("path")), run, JUDGED)


def oracle(rules: Sequence[Rule], vocabulary: Vocabulary = Vocabulary()) -> str:
    """The same judgement as DuckDB SQL over ``pages``."""
    lowered = f"translate(url, '{UPPER}', '{LOWER}')"
    hit = lambda t: f"(CASE WHEN regexp_matches({lowered}, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN 1 ELSE 0 END)"
    strict, soft = (" + ".join(map(hit, ts)) for ts in (vocabulary.strict, vocabulary.soft))
    terms = "concat_ws(',', " + ", ".join(f"CASE WHEN {hit(t)} = 1 THEN '{t}' END" for t in sorted(vocabulary.weights())) + ")"
    ordered = sorted(rules, key=lambda r: -len(r.text))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda value, other: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in ordered) + f" ELSE {other} END"
    return f"""
    WITH parts AS (
        SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
            CAST(coalesce({strict}, 0) AS BIGINT) AS strict_hits, CAST(coalesce({soft}, 0) AS BIGINT) AS soft_hits, {terms} AS terms
        FROM pages)
    SELECT page_id, host, path, {case(lambda r: r.text, "NULL")} AS rule,
        {case(lambda r: r.verdict, f"CASE WHEN strict_hits >= 1 OR soft_hits >= {vocabulary.several} THEN 'block' ELSE 'allow' END")} AS verdict,
        strict_hits, soft_hits, terms
    FROM parts"""
