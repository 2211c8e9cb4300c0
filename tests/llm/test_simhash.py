import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanveil.llm import simhash

from .helpers import corpus, documents, empty, widened


def plain_print(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, bits=4):
    prints = [plain_print(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], f"{p:016x}", least.get(root(i))) for i, (r, p) in enumerate(zip(rows, prints, strict=True))), key=repr)


def near_copies(n=80, copies=120, seed=4):
    """Documents, a large group of near copies of one, and chains."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(draw.randint(1, 60))), "en", "s", 1) for i in range(n)]
    base = [word() for _ in range(400)]
    for i in range(copies):
        own = list(base)
        own[draw.randrange(400)] = word()
        if i % 3 == 0:
            own[draw.randrange(400)] = word()
        rows.append((n + i, " ".join(own), "en", "s", 1))
    return rows


@pytest.mark.parametrize("block", [1024, 8])
def test_groups_equal_brute_force(spark, block):
    rows = corpus() + [(r[0] + 1000, *r[1:]) for r in near_copies()]
    got = simhash.groups(widened(spark, rows), simhash.SimHash(block=block)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_groups(rows)


def test_guarantee_of_matches():
    draw = np.random.default_rng(1)
    options = simhash.SimHash()
    x = draw.integers(0, 1 << 63, 2000, dtype=np.uint64)
    y = x.copy()
    for k in range(2000):
        for b in draw.choice(64, k % 7, replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    got = simhash.verified(x.view(np.uint8).reshape(-1, 8), y.view(np.uint8).reshape(-1, 8), options)
    assert (got == (np.arange(2000) % 7 <= 4)).all()


def test_keep_one(spark):
    rows = corpus()
    docs = widened(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = plain_groups(rows)
    named = {g[2] for g in groups if g[2] is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted((i for i in ids if i is not None)) == sorted(named)
    assert simhash.keep_one(empty(spark)).count() == 0 and simhash.groups(empty(spark)).count() == 0


def test_several_prints_catch_near_copies_and_leave_others(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    rows, alone = [], 200
    for i in range(alone):
        rows.append((i, " ".join(word() for _ in range(200)), "en", "s", 1))
    for i in range(60):  # three changed words in 200 leave at least 0.85 of the shingles
        own = rows[i][1].split()
        for at in draw.sample(range(200), 3):
            own[at] = word()
        rows.append((1000 + i, " ".join(own), "en", "s", 1))
    options = simhash.SimHash.similar(0.8)
    ids = {r["doc_id"] for r in simhash.keep_one(documents(spark, rows), options).collect()}
    assert set(range(alone)) <= ids
    assert len([i for i in ids if i >= 1000]) <= 30


def test_null_only_component_and_repeats(spark):
    rows = [(None, "same words in this text", "en", "s", 1)] * 3 + [(5, "other words are in this one", "en", "s", 1)] * 2
    docs = documents(spark, rows)
    assert simhash.keep_one(docs).count() == 2
    assert [r["component_id"] for r in simhash.groups(docs).where("doc_id is null").collect()] == [None] * 3


def test_very_long_texts_of_many_words(spark):
    draw = random.Random(5)
    words = [f"w{draw.randrange(10**6)}" for _ in range(60_000)]
    near = list(words)
    near[500] = "other"
    rows = [(1, " ".join(words), "en", "s", 1), (2, " ".join(near), "en", "s", 1), (3, " ".join(words[::-1]), "en", "s", 1)]
    assert [r["component_id"] for r in simhash.groups(documents(spark, rows)).orderBy("doc_id").collect()] == [1, 1, 3]
    assert {r["doc_id"] for r in simhash.keep_one(documents(spark, rows), simhash.SimHash.similar(0.8)).collect()} == {1, 3}


def test_postings_hold_every_pair_of_the_minimum():
    """Two fingerprints that share four of eight bytes share a key; no key needs the last byte."""
    from itertools import combinations

    options = simhash.SimHash()
    choices = set(combinations(range(options.first), options.posted))
    assert options.first == 7 and len(choices) == 35
    assert all(any(set(c) <= set(shared) for c in choices) for shared in combinations(range(8), options.matches))


def test_postings_are_not_broadcast(spark, monkeypatch):
    """35 rows are made of each node; Spark guesses their size from the nodes."""
    monkeypatch.setattr(simhash, "settle", lambda df: df)
    nodes = spark.range(1000).select(F.col("id").alias("node"), F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("fp"))
    plan = simhash.shared(simhash.postings(nodes, simhash.SimHash()))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
