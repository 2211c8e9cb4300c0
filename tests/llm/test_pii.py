import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanveil.llm import pii

from .helpers import corpus, documents, empty, widened


def plain(text):
    """The four base kinds by the contract's own patterns."""
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    found += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "-", "+", "1", "22", "255", "256", " ", "(", ")", "4111111111111111", "x@y.z", "1.2.3.4", "%", "é", "\n"]), max_size=24).map("".join))
@settings(max_examples=400, deadline=None)
def test_base_spans_equal_the_patterns(text):
    assert [s[:3] for s in pii.detect(text) if s[0] in pii.BASE] == plain(text)


@pytest.mark.parametrize(("text", "spans"), [
    ("IBAN DE89 3704 0044 0532 0130 00 and more", [("iban", 5, 32)]),
    ("pay GB82WEST12345698765432.", [("iban", 4, 26)]),
    ("DE89 3704 0044 0532 0130 01", []),
    ("my ssn is 123-45-6789", [("ssn", 10, 21)]),
    ("part 123-45-6789", []),
    ("4111 1111 1111 1112", []),
])
def test_added_kinds(text, spans):
    assert [s[:3] for s in pii.detect(text)] == spans


def test_words_nearby_raise_the_score():
    (far,), (near,) = pii.detect("zzz 4111111111111111"), pii.detect("visa card 4111111111111111")
    assert far[3] < near[3]


@pytest.mark.parametrize("text", ["a" * 300_000 + " @", "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "A" * 300_000, "@" * 100_000, "a@" * 100_000])
def test_long_texts_take_linear_time(text):
    import time

    began = time.time()
    pii.detect(text)
    assert time.time() - began < 5


def test_table_and_redaction(spark):
    rows = corpus() + [(900, "Mail x.y@mail5.example.com or +1 (743) 555-3824, card 4111 1111 1111 1111 at 10.0.0.1", "en", "s1", 3)]
    got = pii.digest(pii.find(widened(spark, rows))).collect()
    assert len(got) == len(rows)
    want = {i: hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in plain(t)).encode()).hexdigest() for i, t, *_ in rows}
    assert all(r["base_sha256"] == want[r["doc_id"]] for r in got)
    last = next(r for r in got if r["doc_id"] == 900)
    assert (last["n_email"], last["n_ip"], last["n_card"], last["n_phone"]) == (1, 1, 1, 1)
    wide = widened(spark, rows)
    out = pii.redact(wide)
    assert out.columns == wide.columns and out.count() == len(rows)
    row = out.where("doc_id = 900").first()
    assert row["text"] == "Mail <EMAIL> or <PHONE>, card <CARD> at <IP>" and row["n_chars"] == len(row["text"])
    assert out.where("text is null").count() == 1
    assert pii.digest(pii.find(empty(spark))).count() == 0 and pii.redact(empty(spark)).count() == 0
    assert pii.find(documents(spark)).where("spans is null").count() == 0
