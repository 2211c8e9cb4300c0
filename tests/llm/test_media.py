import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanveil.llm import media

from .helpers import corpus, documents, empty, widened


@given(st.binary(max_size=700))
@settings(max_examples=60, deadline=None)
def test_round_trip(text):
    payload = media.filled(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(text) and not payload[len(text) :].strip(b"\0")
    assert media.decode(media.encode(payload)).tobytes() == payload


def filtered(rows, kinds):
    """Rows under PNG filters, sample by sample."""
    out = []
    for y, kind in enumerate(kinds):
        line = [int(kind)]
        for x in range(rows.shape[1]):
            a = int(rows[y, x - 1]) if x else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((int(rows[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        out.append(line)
    return np.array(out, np.uint8)


def test_all_row_filters():
    draw = np.random.default_rng(3)
    rows = draw.integers(0, 256, (40, 64)).astype(np.uint8)
    kinds = draw.integers(0, 5, 40)
    data = zlib.compress(filtered(rows, kinds).tobytes())
    png = media.SIGNATURE + media.chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 40, 8, 0, 0, 0, 0)) + media.chunk(b"tEXt", b"x") + media.chunk(b"IDAT", data[:100]) + media.chunk(b"IDAT", data[100:]) + media.chunk(b"IEND", b"")
    assert (media.decode(png) == rows).all()


@pytest.mark.parametrize("at", [0, 20, 60, -1, -6])
def test_damage_is_found(at):
    png = bytearray(media.encode(media.filled(b"some text " * 30)))
    png[at] ^= 4
    with pytest.raises((ValueError, zlib.error)):
        media.decode(bytes(png))


def test_table(spark):
    got = media.read_back(media.store(widened(spark))).collect()
    want = []
    for doc_id, text, *_ in corpus():
        raw = (text or "").encode()
        payload = media.filled(raw)
        want.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["error"] is None and len(r["feature"]) == 16 for r in got)
    by_payload = {}
    for r in got:
        assert by_payload.setdefault(r["payload_sha256"], tuple(r)[1:]) == tuple(r)[1:]
    assert media.read_back(media.store(empty(spark))).count() == 0


def test_broken_medium_gives_a_row(spark):
    rows = media.store(documents(spark)).limit(2).collect()
    bad = bytearray(rows[0]["media"])
    bad[50] ^= 1
    got = media.read_back(spark.createDataFrame([(1, 5, bytes(bad)), (2, 5, None)], "doc_id long, n_bytes long, media binary")).orderBy("doc_id").collect()
    assert got[0]["error"].startswith("checksum") and got[0]["payload_bytes"] is None
    assert got[1]["error"] == "no medium"


def test_hash_is_low_frequency():
    smooth = np.kron(np.random.default_rng(2).integers(0, 200, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    noisy = smooth + np.random.default_rng(3).integers(0, 3, (64, 64)).astype(np.uint8)
    near = bin(int(media.frequency_hash(smooth), 16) ^ int(media.frequency_hash(noisy), 16)).count("1")
    other = np.random.default_rng(1).integers(0, 256, (64, 64)).astype(np.uint8)
    assert near <= 6 < bin(int(media.frequency_hash(smooth), 16) ^ int(media.frequency_hash(other), 16)).count("1")


def plain_feature(samples):
    """Cell by cell and frequency by frequency."""
    height, width = len(samples), len(samples[0])
    picture = [[0.0] * 32 for _ in range(32)]

    def shares(n):
        """Of each of 32 stretches of n rows, the rows that it covers and how much of them."""
        return [[(k, min(n * (i + 1) / 32, k + 1) - max(n * i / 32, k)) for k in range(int(n * i / 32), min(n, int(n * (i + 1) / 32) + 1))] for i in range(32)]

    for i, rows in enumerate(shares(height)):
        for j, columns in enumerate(shares(width)):
            picture[i][j] = sum(samples[y][x] * a * b for y, a in rows if a > 0 for x, b in columns if b > 0) * (32 / height) * (32 / width)
    wave = [[math.cos(math.pi * (x + 0.5) * u / 32) for x in range(32)] for u in range(8)]
    low = [round(sum(wave[u][y] * wave[v][x] * picture[y][x] for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return f"{int(''.join('1' if f > middle else '0' for f in low), 2):016x}"


@pytest.mark.parametrize("height", [1, 5, 32, 77])
def test_feature_equals_a_plain_version(height):
    samples = np.random.default_rng(height).integers(0, 256, (height, 64), dtype=np.uint8)
    assert media.frequency_hash(samples) == plain_feature(samples.tolist())
