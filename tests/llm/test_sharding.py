import hashlib
import zlib
from collections import Counter

import pytest
import xxhash

from spanveil.llm import sharding

from .helpers import corpus, empty, documents, widened


def check(got, rows, shards):
    assert len(got) == len(rows)
    counts = Counter(r["shard"] for r in got)
    full = [counts.get(s, 0) for s in range(shards)]
    assert max(full) - min(full) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(full[s]))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def uncut(got):
    return sum(n * (n - 1) // 2 for n in Counter((r["text_crc32"], r["size"], r["shard"]) for r in got).values())


def test_counts_slots_and_groups(spark):
    rows = corpus(200)
    rows += [(1000 + i, rows[i % 40][1], "en", "s", 1) for i in range(120)]  # groups of four
    got = sharding.shard(widened(spark, rows)).collect()
    check(got, rows, 24)
    groups = Counter((r["text_crc32"], r["size"]) for r in got)
    assert uncut(got) >= 0.9 * sum(n * (n - 1) // 2 for n in groups.values())


def test_group_larger_than_a_shard(spark):
    rows = [(i, "the same text", "en", "s", 1) for i in range(100)] + [(100 + i, f"text {i}", "en", "s", 1) for i in range(140)]
    got = sharding.shard(documents(spark, rows)).collect()
    check(got, rows, 24)
    held = Counter(r["shard"] for r in got if r["doc_id"] < 100)
    assert sum(1 for n in held.values() if n == 10) >= 6  # whole shards of one text


def test_only_copies_and_few_rows(spark):
    rows = [(i, "copy", "en", "s", 1) for i in range(50)]
    check(sharding.shard(documents(spark, rows)).collect(), rows, 24)
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", "s", 0)]
    check(sharding.shard(documents(spark, rows), sharding.Sharding(shards=2)).collect(), rows, 2)
    assert sharding.shard(empty(spark)).count() == 0


def test_reruns_agree(spark):
    docs = documents(spark, corpus(80))
    one, two = (sorted(map(tuple, sharding.shard(d).collect()), key=repr) for d in (docs, docs.repartition(3)))
    assert one == two


def test_full_shards_exchange(spark):
    rows = [(i, f"text {i // 2}", "en", "s", 1) for i in range(2400)]  # pairs only: all places are taken
    got = sharding.shard(documents(spark, rows)).collect()
    check(got, rows, 24)
    assert uncut(got) >= 0.85 * 1200


def test_circulation_ends_where_it_began_or_in_free_places():
    out = sharding.circulation([[0, 5, 0], [0, 0, 4], [3, 0, 0]], [0, 0, 1])
    assert out == [[0, 3, 0], [0, 0, 4], [3, 0, 0]] or out == [[0, 4, 0], [0, 0, 4], [3, 0, 0]]
    into, gone = ([sum(row[k] for row in out) for k in range(3)], [sum(row) for row in out])
    assert all(i - g <= f for i, g, f in zip(into, gone, [0, 0, 1], strict=True))


def mixed(*values, seed=42):
    """XXH64 of values one after the other, as Spark chains them: 4 or 8 bytes a number, nulls left out; signed."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64(v if isinstance(v, bytes) else v, seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def four(n):
    return n.to_bytes(4, "little", signed=True)


def eight(n):
    return None if n is None else n.to_bytes(8, "little", signed=True)


def nulls_first(*values):
    return tuple((v is not None, v) for v in values)


def plain_rounds(state, quotas):
    """Label propagation move by move. state: documents of a text in a shard."""
    count, still, turn, exchange = len(quotas), 0, 0, False
    together = sum(n * n for n in state.values())
    while still < 2 and state:
        loads = [sum(n for (_, s), n in state.items() if s == k) for k in range(count)]
        free = [max(0, q - n) for q, n in zip(quotas, loads, strict=True)]
        rank = {(t, s): (n, mixed(t, four(s)), s) for (t, s), n in state.items()}
        label = {}
        for (t, s), r in rank.items():
            if (exchange or free[s] > 0) and r > label.get(t, (0, 0, 0)):
                label[t] = r
        moves = [(label[t][2], -(label[t][0].bit_length() - 1), mixed(t, four(s)) % 1024, t, s, state[t, s]) for (t, s), r in rank.items() if t in label and label[t][2] != s and r < label[t]]
        room = {}
        if exchange:
            wants = [[sum(m[5] for m in moves if m[4] == a and m[0] == b) for b in range(count)] for a in range(count)]
            room = {(a, b): n for a, row in enumerate(sharding.circulation(wants, free)) for b, n in enumerate(row)}
        for to, _, _, t, s, n in sorted(moves, key=lambda m: m[1:5]):
            key = (s, to) if exchange else to
            left = room.setdefault(key, free[to] if not exchange else 0)
            moved = min(n, max(0, left))
            room[key] = left - n
            if moved:
                state[t, s] -= moved
                state[t, to] = state.get((t, to), 0) + moved
        state = {k: n for k, n in state.items() if n}
        before, together = together, sum(n * n for n in state.values())
        still = still + 1 if together == before else 0
        turn += 1
        exchange = exchange != (still > 0 or turn >= 6)
    return state


def plain_shards(rows, shards):
    docs = []
    for doc_id, text, *_ in rows:
        data = None if text is None else text.encode()
        docs.append((doc_id, len(data or b"") + 8, zlib.crc32(data or b""), None if data is None else hashlib.md5(data).digest()))
    quotas = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    salt = lambda d: mixed(eight(d[0]), eight(d[1]), eight(d[2])) % 1024
    fine = lambda d: mixed(four(1), eight(d[0]), eight(d[1]), eight(d[2])) % 1024
    state, every = Counter(), Counter(d[3] for d in docs)
    for d in docs:
        if d[3] is not None and every[d[3]] > 1:
            state[d[3], mixed(eight(d[0]), eight(d[1])) % shards] += 1
    state = plain_rounds(dict(state), quotas)
    stretches, loads = {}, [0] * shards
    for (t, s), n in sorted(state.items(), key=lambda x: (x[0][1], mixed(x[0][0]) % 1024, x[0][0])):
        n = min(n, quotas[s] - loads[s])
        if n > 0:
            loads[s] += n
            stretches.setdefault(t, []).append((s, n))
    out, free = [], []
    for t in every:
        own = sorted((d for d in docs if d[3] == t), key=lambda d: (salt(d), nulls_first(*d[:3])))
        places = [s for s, n in sorted(stretches.get(t, [])) for _ in range(n)]
        out += [(d, s) for d, s in zip(own, places, strict=False)]
        free += own[len(places) :]
    places = [s for s in range(shards) for _ in range(quotas[s] - loads[s])]
    out += zip(sorted(free, key=lambda d: (salt(d), fine(d), nulls_first(*d[:3]))), places, strict=True)
    found = []
    for s in range(shards):
        own = sorted((d for d, k in out if k == s), key=lambda d: (salt(d), nulls_first(*d[:3])))
        found += [(*d[:3], s, slot) for slot, d in enumerate(own)]
    return sorted(found, key=repr)


@pytest.mark.parametrize("shards", [2, 5, 24])
def test_equals_propagation_move_by_move(spark, shards):
    rows = corpus(50) + [(1000 + i, f"copy {i % 9}", "en", "s", 1) for i in range(70)] + [(2000 + i, "hot", "en", "s", 1) for i in range(45)]
    got = sharding.shard(widened(spark, rows), sharding.Sharding(shards=shards)).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(tuple, got), key=repr) == plain_shards(rows, shards)
