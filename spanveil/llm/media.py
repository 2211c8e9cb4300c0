"""Media columns: texts stored as PNG images in a binary column, read back through checksum tests, with perceptual hashes.

``store`` writes the bytes of a text, filled with bytes 0 to a positive multiple of the row width, as an 8-bit grey image: signature,
IHDR, one or more IDAT chunks of one zlib stream, IEND, each chunk with its CRC-32. ``read_back`` walks the chunks, tests every CRC, inflates, undoes the row filters in numpy and
takes a hash of the lowest frequencies of the image's cosine transform. A broken medium gives a row with ``error`` and nulls instead of ending the job.

Everything is row by row: no shuffle, memory bounded by a few rows' bytes (batches are cut at 8 MB, a longer text is a batch by itself), lost executors repeat only their tasks.

Defined cases: a null or empty text is one row of 64 bytes 0; equal texts give equal media and features; a null doc_id stays null; a very long text is one tall image, held a few times over by
its task; frequencies that equal the median are not above it; repeated rows stay repeated; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Bytes of compressed data in a chunk.
CHUNK = 1 << 16
#: The hash compares the lowest EDGE x EDGE frequencies of a GRID x GRID picture.
GRID, EDGE = 32, 8


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filled(text: bytes, width: int = WIDTH) -> bytes:
    return text + bytes(-len(text) % width or (0 if text else width))


def encode(payload: bytes, width: int = WIDTH, level: int = 2) -> bytes:
    """A grey 8-bit PNG, all of its rows with filter none or all with filter up, whichever deflates to less."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = np.zeros((len(rows), width + 1), np.uint8)
    out[:, 1:] = rows
    data = zlib.compress(out.tobytes(), level)
    out[:, 0] = 2
    out[1:, 1:] -= rows[:-1]
    data = min(data, zlib.compress(out.tobytes(), level), key=len)
    parts = [chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)]
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + b"".join(parts) + chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kinds and data; ValueError at a wrong signature, length, or checksum."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("chunk cut short")
        (length,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + length]
        if at + 12 + length > len(png):
            raise ValueError("chunk cut short")
        if struct.unpack_from(">I", png, at + 8 + length)[0] != zlib.crc32(kind + data):
            raise ValueError(f"checksum of {kind!r}")
        yield kind, data
        at += 12 + length
        if kind == b"IEND":
            return
    raise ValueError("no IEND chunk")


def unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undo PNG's row filters 0 to 4; runs of rows of one simple kind are undone together."""
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    out = rows.copy()
    begins = np.flatnonzero(np.concatenate(([True], kinds[1:] != kinds[:-1])))
    for begin, end in zip(begins, [*begins[1:], len(kinds)], strict=True):
        kind = kinds[begin]
        if kind == 1:
            wide = out[begin:end].reshape(end - begin, -1, step)
            np.cumsum(wide, axis=1, dtype=np.uint8, out=wide)
        elif kind == 2:
            if begin:
                out[begin] += out[begin - 1]
            np.cumsum(out[begin:end], axis=0, dtype=np.uint8, out=out[begin:end])
        elif kind > 2:
            for y in range(begin, end):
                above = out[y - 1].tolist() if y else [0] * out.shape[1]
                line = out[y].tolist()
                for x in range(len(line)):
                    a, b, c = line[x - step] if x >= step else 0, above[x], above[x - step] if x >= step else 0
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        p = a + b - c
                        guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                    line[x] = (line[x] + guess) & 255
                out[y] = line
    return out


def decode(png: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG without interlace."""
    header, data = None, []
    for kind, part in chunks(png):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            data.append(part)
        elif not kind[0] & 32 and kind not in (b"IEND", b"PLTE"):
            raise ValueError(f"unknown critical chunk {kind!r}")
    if header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a grey 8-bit image without interlace")
    width, height = header[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if raw.size != height * (width + 1):
        raise ValueError("wrong number of samples")
    raw = raw.reshape(height, width + 1)
    return unfilter(raw[:, 0], raw[:, 1:], 1)


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (np.arange(n)[None, :] + 0.5) * np.arange(k)[:, None] / n)


COSINES = _cosines(GRID, EDGE)


def shrink(samples: np.ndarray, grid: int = GRID, axis: int = 0) -> np.ndarray:
    """Mean over ``grid`` equal stretches of an axis, by exact areas."""
    samples = np.moveaxis(samples, axis, 0)
    n = samples.shape[0]
    sums = np.concatenate((np.zeros((1, samples.shape[1])), np.cumsum(samples, axis=0, dtype=np.float64)))
    whole, part = np.divmod(np.arange(grid + 1) * n, grid)
    edges = sums[whole]
    inner = part > 0
    edges[inner] += samples[whole[inner]] * (part[inner] / grid)[:, None]
    return np.moveaxis(np.diff(edges, axis=0) * (grid / n), 0, axis)


def frequency_hash(samples: np.ndarray) -> str:
    """64 bits as hex: which of the lowest frequencies lie above their median."""
    picture = shrink(shrink(samples, axis=0), axis=1)
    low = np.round(COSINES @ picture @ COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def store(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """key, n_bytes and the PNG of each text in the binary column ``media``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [x or b"" for x in batch.column("text").to_pylist()]
            made = [encode(filled(x, width), width) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(map(len, texts), pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_arrow(df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text")), write, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def read_back(media: DataFrame) -> DataFrame:
    """Features of stored media, computed from the samples that are read back."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for doc_id, n_bytes, png in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                if png is None:
                    rows.append((doc_id, n_bytes, *[None] * 6, "no medium"))
                    continue
                stored = (len(png), hashlib.sha256(png).hexdigest())
                try:
                    samples = decode(png)
                except (ValueError, zlib.error) as e:
                    rows.append((doc_id, n_bytes, None, None, None, *stored, None, str(e)))
                    continue
                payload = samples.tobytes()
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, frequency_hash(samples), None))
            names = [x.split()[0] for x in FEATURES.split(", ")]
            kinds = [pa.int64() if x.endswith("long") else pa.string() for x in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return map_arrow(media.select("doc_id", "n_bytes", "media"), read, FEATURES)
