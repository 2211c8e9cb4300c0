import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanveil.llm import packing
from spanveil.llm.queries import tokenizer_file

from .helpers import corpus, empty, documents, widened

TOKENIZER = Tokenizer.from_file(tokenizer_file())


def ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


@given(st.lists(st.sampled_from(["the", "The", "HOUSE", "it's", "don't", ",", ".", "...", "%%%", "|", "a|b", "<|endoftext|>", "<|ENDOFTEXT|>", "é", "É", "é", "straße", "İ", "Σας", "１", "123", "a1b", " ", "\n", "\t", " ", " ", "\x1c", "日本", "😀", "'", "_", "x_y", "-"]), max_size=14), st.sampled_from(["", " "]))
@settings(max_examples=400, deadline=None)
def test_words_give_the_ids_of_texts(parts, joint):
    text = joint.join(parts)
    got = packing.tokenizer_words(tokenizer_file(), 1000).ids([text.encode()])[0]
    assert np.frombuffer(got, "<u4").tolist() == ids(text)[:-1]


def brute(ends, costs, size):
    """The cheapest choice of cuts by trying all; the last window is not charged."""
    best = None
    n = len(ends)
    for chosen in itertools.product((0, 1), repeat=n - 1):
        at, total = 0, 0.0
        for end, cost, cut in [*zip(ends[:-1], costs[:-1], chosen, strict=True)]:
            if cut:
                length = end - at
                if length > size:
                    break
                total += cost + (0 if length & (length - 1) == 0 and length >= size // 8 and length < size else size - length)
                at = end
        else:
            if ends[-1] - at <= size and (best is None or total < best):
                best = total
    return best


@given(st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0.0, 1.0, 5.0])), min_size=1, max_size=11))
@settings(max_examples=200, deadline=None)
def test_programme_equals_brute_force(parts):
    ends = np.cumsum([n for n, _ in parts])
    costs = np.array([c for _, c in parts])
    got, cost = packing.cuts(ends, costs, 16)
    assert got[-1] == ends[-1] and (np.diff(np.concatenate(([0], got))) <= 16).all()
    assert cost == pytest.approx(brute(ends.tolist(), costs.tolist(), 16))


@pytest.mark.parametrize(("size", "block"), [(4096, 1 << 20), (64, 500), (16, 100)])
def test_pieces(spark, size, block):
    rows = [r for r in corpus() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    docs = widened(spark, rows).coalesce(2)
    got = packing.pack(docs, tokenizer_file(), packing.Packing(size=size, block=block)).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == {r[0] for r in rows}
    for doc_id, text, *_ in rows:
        want, at = ids(text), 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(np.array(want[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size and {r["sequence_length"] for r in own} == {at}


def test_little_padding(spark):
    rows = [(i, t, lang, s, n) for i, (_, t, lang, s, n) in enumerate(corpus(3000, 5))]
    got = packing.pack(documents(spark, rows).coalesce(1), tokenizer_file()).select("sequence_id", "sequence_length").distinct().collect()
    lengths = [r["sequence_length"] for r in got]
    padding = sum(4096 - n for n in lengths if n & (n - 1))
    assert padding < 0.02 * sum(lengths)


def test_odd_rows(spark):
    rows = [(None, "a text", None, None, None), (1, None, None, None, None), (1, None, None, None, None), (2, "", None, None, None)]
    got = packing.pack(documents(spark, rows), tokenizer_file()).collect()
    assert sum(r["length"] for r in got) == len(ids("a text")) + 3
    assert packing.pack(empty(spark), tokenizer_file()).count() == 0


class Counting(dict):
    """Counts how often it is asked."""

    asked = 0

    def __getitem__(self, word):
        self.asked += 1
        return super().__getitem__(word)


def test_repeated_words_are_looked_up_once():
    words = packing.Words(tokenizer_file(), 1000)
    words.known = Counting()
    texts = ["the house, über " * 500, "", "the  house, <|endoftext|> The\n" * 300]
    assert [x.tolist() for x in map(np.asarray, words.ids([t.encode() for t in texts]))] == [ids(t)[:-1] for t in texts]
    assert words.known.asked < 20


def test_words_of_letters_are_asked_for_together():
    words = packing.Words(tokenizer_file(), 1000)
    western = ["über", "größe", "é", "straße", "ÀÉ", "naïveté" * 30]
    assert words.together([w.encode() for w in western]) == []
    assert [np.frombuffer(words.known[w.encode()], "<u4").tolist() for w in western] == [ids(w)[:-1] for w in western]
    assert words.together([b"it's", b"x"]) == [b"it's", b"x"]  # ids end a word more than once there


def test_boundaries_where_ends_meet():
    place, cost = packing.boundaries(np.array([5, 1, 7, 2, 1, 2, 9, 9, 9, 2], np.uint32), np.array([4, 6, 10]), np.array([1, 7]), packing.Packing(size=8))
    assert place.tolist() == [2, 3, 4, 5, 6, 8, 10] and cost.tolist() == [6, 6, 0, 6, 0, 48, 0]
