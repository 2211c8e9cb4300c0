"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Kinds, in their order: email, ip, card (Luhn), phone; and, added by this method, iban (mod 97) and ssn (kept by score: a bare number
needs one of its words nearby). The first four follow fixed patterns, leftmost and without overlap within a kind, and are kept
whatever their score. All scans are linear in the text: no pattern starts again inside a run that it has read, so very long texts
without any match cost one pass.

Everything is row by row: no shuffle, batches are cut at 8 MB, lost executors repeat only their tasks.

Defined cases: a null or empty text has no spans (``redact`` keeps null as null); repeated rows stay repeated; a null doc_id stays
null; an empty table gives no rows; ``redact`` keeps every other column, whatever its name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: Characters, patterns and lengths of the kinds; country lengths of the account numbers that are tested.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BI=27, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DJ=27, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FK=18, FO=18,
    FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HN=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27,
    MD=24, ME=22, MK=19, MN=20, MR=27, MT=31, MU=30, NI=28, NL=18, NO=15, OM=23, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, RU=33, SA=24, SC=31, SD=18, SE=24, SI=19, SK=24, SM=27,
    SO=23, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20, YE=30,
)
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.35}
WORDS = re.compile(r"[A-Za-z-]+")


@dataclass(frozen=True)
class Detection:
    window: int = 40
    bonus: float = 0.2
    least: float = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) << at % 2
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(account: str) -> bool:
    compact = account.replace(" ", "")
    if len(compact) != IBAN_LENGTHS.get(compact[:2]):
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is looked at once: the run of local characters before it, since the last match, and the domain behind it."""
    free, at = 0, text.find("@")
    while at >= 0:
        head = text[free:at]
        local = len(head) - len(head.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if local else None
        if found:
            yield at - local, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def plain(digits: str) -> str:
    return re.sub("[^0-9]", "", digits)


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in emails(text):
        yield "email", start, end
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(number := plain(m[0])) <= 19 and luhn(number):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(plain(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        compact = m[0].replace(" ", "")
        length = IBAN_LENGTHS.get(compact[:2], 0)
        end, seen = m.start(), 0
        while seen < min(length, len(compact)):  # the pattern may have run on into the next words
            seen += text[end] != " "
            end += 1
        if length and seen == length and not text[end : end + 1].isalnum() and mod97(text[m.start() : end]):
            yield "iban", m.start(), end
    for m in SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def detect(text: str | None, options: Detection = Detection()) -> list[tuple[str, int, int, float]]:
    """Kind, start, end and score of each span, by start and then by kind; offsets are code points, ends are exclusive."""
    found = []
    text = text or ""
    for kind, start, end in proposals(text):
        near = {w.lower() for w in WORDS.findall(text[max(0, start - options.window) : start] + " " + text[end : end + options.window // 2])}
        score = min(1.0, SCORES[kind] + options.bonus * (not near.isdisjoint(CONTEXT[kind])))
        if kind in BASE or score >= options.least:
            found.append((kind, start, end, round(score, 3)))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Each stretch that spans cover becomes one tag, of the kind of its first span."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>"


def find(docs: DataFrame, options: Detection = Detection()) -> DataFrame:
    """doc_id and the spans of each text."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in detect(t, options)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SPANS)


def listing(spans: list[tuple[str, int, int, float]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans if k in kinds)


def digest(spans: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and the list of all spans, from ``find``."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda column: F.concat_ws(",", F.transform(column, text))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    digested = F.sha2(joined(base).cast("binary"), 256).alias("base_sha256")
    return spans.select("doc_id", *counts[: len(BASE)], digested, joined(F.col("spans")).alias("spans"), *counts[len(BASE) :], F.col("spans.score").alias("scores"))


def redact(docs: DataFrame, options: Detection = Detection()) -> DataFrame:
    """The documents with tags in place of their spans; n_chars, where there is such a column, follows the text."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names[at]):
            texts = [t if t is None else masked(t, detect(t, options)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names and pa.types.is_integer(columns[names.index("n_chars")].type):
                old = columns[names.index("n_chars")]
                columns[names.index("n_chars")] = pa.array([n if t is None else len(t) for t, n in zip(texts, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_arrow(docs, run, docs.schema)
