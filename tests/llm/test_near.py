import random

import numpy as np

from spanveil.llm import near, simhash

from .helpers import documents


def similarity(a, b, shingle=5):
    x, y = ({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def planted(pairs, low, high, seed, words=(300, 1000)):
    """Pairs of texts whose shingle sets have a similarity between the two; ids k and 10000 + k."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    rows = []
    while len(rows) < 2 * pairs:
        n = draw.choice(words)
        base = [word() for _ in range(n)]
        own = list(base)
        share = draw.uniform(low, high)
        for at in draw.sample(range(n), max(1, round(n * (1 - share) / (1 + share) / 5))):
            own[at] = word()
        one, two = " ".join(base), " ".join(own)
        if low <= similarity(one, two) <= high:
            k = len(rows) // 2
            rows += [(k, one, "en", "s", 1), (10000 + k, two, "en", "s", 1)]
    return rows


def test_isolated_pairs_just_above_the_limit_are_found(spark):
    rows = planted(300, 0.82, 0.87, 3)
    ids = {r["doc_id"] for r in simhash.keep_one(documents(spark, rows), simhash.SimHash.similar(0.8)).collect()}
    assert set(range(300)) <= ids and len(ids) == 300  # eight SimHash fingerprints found 274 of the 300


def test_pairs_at_the_limit_meet_in_a_band():
    rows = planted(300, 0.8, 0.82, 4, words=(300,))
    options = near.Near()
    marks = [np.frombuffer(near.mark(r[1].encode(), options), np.uint8)[: options.size].reshape(-1, near.ROWS) for r in rows]
    assert all((a == b).all(axis=1).any() for a, b in zip(marks[::2], marks[1::2], strict=True))


def test_pairs_below_the_limit_stay_and_do_not_chain(spark):
    rows = planted(150, 0.7, 0.78, 5, words=(300,))
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    template = [word() for _ in range(300)]
    for k in range(30):  # a family of which any two are below the limit
        own = list(template)
        for at in draw.sample(range(10 * (k % 3), 300, 30), 5) + draw.sample(range(5, 300, 30), 4):
            own[at] = word()
        rows.append((20000 + k, " ".join(own), "en", "s", 1))
    family = [r[1] for r in rows[-30:]]
    assert all(similarity(a, b) < 0.8 for i, a in enumerate(family) for b in family[:i])
    ids = {r["doc_id"] for r in simhash.keep_one(documents(spark, rows), simhash.SimHash.similar(0.8)).collect()}
    assert ids == {r[0] for r in rows}


def test_brute_force_over_mixed_similarities(spark):
    rows = planted(60, 0.6, 0.95, 7, words=(40, 120))
    want = {r[0] for r in rows} - {b[0] for a, b in zip(rows[::2], rows[1::2], strict=True) if similarity(a[1], b[1]) >= 0.8}
    assert {r["doc_id"] for r in simhash.keep_one(documents(spark, rows), simhash.SimHash.similar(0.8)).collect()} == want


def test_simhashes_link_before_any_band(spark, monkeypatch):
    """Without bands: pairs that differ in few bits are found by their SimHashes, and the sets decide."""
    monkeypatch.setattr(near, "postings", lambda nodes, options: spark.createDataFrame([], "key long, node long"))
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    rows = [(k, " ".join(word() for _ in range(500)), "en", "s", 1) for k in range(40)]
    rows += [(1000 + k, f"{rows[k][1]} {word()}", "en", "s", 1) for k in range(40)]
    marks = [near.mark(r[1].encode(), near.Near()) for r in rows]
    assert marks[0][-8:] == simhash.fingerprint(rows[0][1].encode(), 5) and near.mark(b"", near.Near())[-8:] == bytes(8)
    bits = [sum((x ^ y).bit_count() for x, y in zip(a[-8:], b[-8:], strict=True)) for a, b in zip(marks[:40], marks[40:], strict=True)]
    ids = {r["doc_id"] for r in simhash.keep_one(documents(spark, rows), near.Near()).collect()}
    assert ids == set(range(40)) | {1000 + k for k in range(40) if bits[k] > 4} and len(ids) < 60
    far = planted(60, 0.7, 0.78, 9, words=(300,))
    wide = near.Near(prints=simhash.SimHash(bits=64, matches=0, posted=0))  # all pairs meet
    assert len(simhash.keep_one(documents(spark, far), wide).collect()) == len(far)


def test_no_pair_is_no_link():
    none, one = np.zeros((0, 8), np.uint8), np.zeros((1, 8), np.uint8)
    assert simhash.verified(none, one, simhash.SimHash()).shape == (0,)
