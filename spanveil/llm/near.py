"""Near-duplicates by the Jaccard similarity of shingle sets: an inverted index over byte positions finds candidates, the sets themselves decide.

The first turn is the method of ``simhash``: the SimHash of a text's set is posted under three of its first seven bytes, pairs that meet have their
positional bytes tallied and their bits verified, and the exact similarity of their sets then decides. SimHash bits do not reach all of a similarity of
0.8 (see the README), so further turns follow with other bytes, over what the first one has not joined. A text's set
is the distinct XXH64 hashes of its word shingles, its second fingerprint the last bytes of ``BANDS * ROWS`` MinHashes a seed. The index posts
every band of ``ROWS`` positions with its bytes. A pair of similarity s shares a band with a probability of 1 - (1 - s**ROWS)**bands, which for the 32
bands of 8 seeds leaves out 3 in a million pairs at 0.8 and fewer above.

Pairs that meet in a list have their shared positional bytes tallied; those over five deviations below the limit's share go (a link is lost so about
once in three million). The others are verified by their sets, so that no link is below the limit. A pair belongs to the first band that it
shares and is looked at there alone. Sets move to the cells of the lists, once for each cell that needs them, and not with each pair; a cell
joins what it has linked and returns a forest of its links. So no rows grow with the square of a list.

Equal sets are one node. Lists with one member, or with one component already, go before any pair is formed; long lists, and lists of
long texts, are cut into blocks (``simhash.cells``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import discard, map_arrow, rows_of_bytes, settle, slices, whole_groups
from .graph import components
from .simhash import CELL, SEED, SMALL, cells, shared, shingle_hashes, small_pairs

#: Bands of a seed, and MinHashes of a band.
BANDS, ROWS = 4, 5
#: Bytes behind the MinHashes: the set's own digest, the set's size, and its SimHash.
DIGEST, SIZE, PRINT = 16, 4, 8
#: What stands for a band in the turn of the SimHashes.
BITS = -1


@dataclass(frozen=True)
class Near:
    #: Least Jaccard similarity of a link.
    least: float = 0.8
    shingle: int = 5
    seeds: tuple[int, ...] = tuple(range(SEED, SEED + 8))
    #: Members of a list that are compared in one go; longer lists are cut into blocks.
    block: int = 1024
    #: Bands whose links are joined before the others are looked at.
    early: int = 2
    #: The turn of the SimHashes.
    prints: simhash.SimHash = simhash.SimHash()

    @property
    def bands(self) -> int:
        return BANDS * len(self.seeds)

    @property
    def size(self) -> int:
        """MinHashes of a text."""
        return ROWS * self.bands

    @property
    def fewest(self) -> int:
        """Shared positional bytes that a pair at the limit misses only by more than five deviations."""
        return int(self.size * self.least - 5 * np.sqrt(self.size * self.least * (1 - self.least)))


def shingle_set(text: bytes | None, options: Near) -> np.ndarray:
    """Distinct hashes in order; none without words."""
    hashes = shingle_hashes(text, options.shingle)
    return np.zeros(0, np.uint64) if hashes is None else np.unique(hashes)


def salts(options: Near) -> tuple[np.ndarray, np.ndarray]:
    """What is added (by exclusive or) and an odd factor, for each MinHash."""
    drawn = np.concatenate([np.random.default_rng(seed).integers(1 << 32, size=(BANDS * ROWS, 2), dtype=np.uint32) for seed in options.seeds])
    return drawn[:, :1], drawn[:, 1:] | np.uint32(1)


def mark(text: bytes | None, options: Near) -> bytes:
    """A byte of each MinHash, a digest of the set, the number of its members and its SimHash; zeros without words."""
    from xxhash import xxh3_128_digest

    own = shingle_set(text, options)
    if not len(own):
        return bytes(options.size + DIGEST + SIZE + PRINT)
    add, times = salts(options)
    folded = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    least = np.full(options.size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 512):
        np.minimum(least, ((folded[None, at : at + 512] ^ add) * times).min(axis=1), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes() + xxh3_128_digest(own.tobytes()) + len(own).to_bytes(SIZE, "big") + simhash.majority(own)


def band_keys(fps: np.ndarray, options: Near) -> np.ndarray:
    """Of each fingerprint a number for each band: the band and its bytes."""
    values = fps[:, : options.size].reshape(len(fps), -1, ROWS)
    keys = np.zeros((len(fps), options.bands), np.int64)
    for k in range(ROWS):
        keys = (keys << 8) | values[:, :, k]
    return keys | (np.arange(options.bands, dtype=np.int64) << 8 * ROWS)


def postings(nodes: DataFrame, options: Near) -> DataFrame:
    """key and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(rows_of_bytes(batch.column("fp")), options)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("node").to_numpy(), options.bands))], ["key", "node"])

    return map_arrow(nodes.select("node", "fp"), run, "key long, node long")


def hopeful(x: np.ndarray, y: np.ndarray, kx: np.ndarray, ky: np.ndarray, band: int, options: Near) -> np.ndarray:
    """Which pairs may reach the limit and share no earlier band. x, y: fingerprints, kx, ky: their band keys, one row each (or one row for all).

    In the turn of the SimHashes: which pairs share enough of their bytes and differ in few bits.
    """
    if band == BITS:
        return simhash.verified(x[:, -PRINT:], y[:, -PRINT:], options.prints)
    good = (x[:, : options.size] == y[:, : options.size]).sum(axis=1) >= options.fewest
    return good & ~(kx[:, :band] == ky[:, :band]).any(axis=1) if band else good


def bands_of(part: pa.RecordBatch, bits: bool) -> np.ndarray:
    """The band of each row's key."""
    return np.full(part.num_rows, BITS) if bits else part.column("key").to_numpy() >> 8 * ROWS


def pending(dealt: DataFrame, options: Near, bits: bool = False) -> DataFrame:
    """The rows of the cells that stand in a pair that may be a link: key, lo, hi, side, node, root, fp. bits: the lists are those of the SimHashes."""
    columns = [*CELL, "side", "node", "root", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, begins, ends in whole_groups(batches, CELL):
            root, side, fps = part.column("root").to_numpy(), part.column("side").to_numpy(), rows_of_bytes(part.column("fp"))
            keys, band = band_keys(fps, options), bands_of(part, bits)
            needed = np.zeros(part.num_rows, bool)
            small = ends - begins <= SMALL
            for i, j in small_pairs(begins[small], (ends - begins)[small]):
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
                for k in np.unique(band[i]):
                    own = band[i] == k
                    a, b = i[own], j[own]
                    good = hopeful(fps[a], fps[b], keys[a], keys[b], int(k), options)
                    needed[a[good]] = needed[b[good]] = True
            for begin, end in zip(begins[~small].tolist(), ends[~small].tolist(), strict=True):
                two = bool(side[begin:end].any())
                for i in range(begin, end - 1):
                    later = np.arange(i + 1, end)
                    later = later[(root[later] != root[i]) & ((side[later] != side[i]) if two else True)]
                    later = later[hopeful(fps[later], fps[i : i + 1], keys[later], keys[i : i + 1], int(band[i]), options)]
                    needed[later] = True
                    needed[i] |= bool(len(later))
            if needed.any():
                yield part.select(columns).filter(pa.array(needed))

    return map_arrow(dealt.select(*columns), run, "key long, lo int, hi int, side int, node long, root long, fp binary")


def similar(one: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Which of the sets have a Jaccard similarity of at least ``least`` with the first one. Sets are in order and not empty."""
    sizes = np.array([len(x) for x in others])
    good = np.minimum(sizes, len(one)) >= least * np.maximum(sizes, len(one))
    for at in range(0, len(others), 64):
        own = at + np.flatnonzero(good[at : at + 64])
        if len(own):
            flat = np.concatenate([others[k] for k in own])
            met = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
            both = np.add.reduceat(met.astype(np.int64), np.concatenate(([0], np.cumsum(sizes[own])[:-1])))
            good[own] = both >= least * (len(one) + sizes[own] - both)
    return good


def decided(waiting: DataFrame, options: Near, bits: bool = False) -> DataFrame:
    """a, b: roots that the links of the cells connect. waiting: as ``pending`` gives it, and set; each cell's rows together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, begins, ends in whole_groups(batches, CELL):
            root, side, fps, sets = part.column("root").to_numpy(), part.column("side").to_numpy(), rows_of_bytes(part.column("fp")), part.column("set")
            keys, band = band_keys(fps, options), bands_of(part, bits)
            seen: set[tuple[int, int]] = set()
            for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
                own = [np.frombuffer(sets[k].as_buffer(), np.uint64) for k in range(begin, end)]
                label, two = root[begin:end].copy(), bool(side[begin:end].any())
                for i in range(end - begin - 1):
                    later = np.arange(i + 1, end - begin)
                    later = later[(label[later] != label[i]) & ((side[begin + later] != side[begin + i]) if two else True)]
                    later = later[hopeful(fps[begin + later], fps[begin + i : begin + i + 1], keys[begin + later], keys[begin + i : begin + i + 1], int(band[begin]), options)]
                    if len(later):
                        later = later[similar(own[i], [own[k] for k in later], options.least)]
                        for met in np.unique(label[later]).tolist():
                            seen.add((max(met, int(label[i])), min(met, int(label[i]))))
                        label[np.isin(label, label[later])] = label[i]
            if seen:
                a, b = zip(*seen, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_arrow(waiting, run, "a long, b long")


def sets(texts: DataFrame, options: Near) -> DataFrame:
    """node and set, the hashes' bytes. texts: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingle_set(t, options).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], ["node", "set"])

    return map_arrow(texts, run, "node long, set binary")


def rooted(nodes: DataFrame, texts: DataFrame, options: Near) -> DataFrame:
    """The nodes with the root of their component. nodes: node, fp, best (with the row of the text); texts: row and text.

    The links of the SimHashes are joined first, then those of the first bands: what they connect need not be compared again under the others.
    """
    weight = F.conv(F.hex(F.substring("fp", options.size + DIGEST + 1, SIZE)), 16, 10).cast("long") * 8
    first, nodes = nodes, nodes.withColumn("root", F.col("node")).withColumn("weight", weight)

    def met(posted: DataFrame, nodes: DataFrame, bits: bool = False) -> DataFrame:
        members = posted.join(nodes.select("node", "root", "weight", "fp"), "node").select("key", "node", "root", "weight", "fp")
        return pending(cells(members, options.block), options, bits)

    prints = nodes.select("node", F.substring("fp", options.size + DIGEST + SIZE + 1, PRINT).alias("fp"))
    listed = shared(simhash.postings(prints, options.prints))
    alike = settle(met(listed, nodes, True))
    discard(listed)
    posted = shared(postings(nodes, options))
    row = first.select("node", F.col("best.row").alias("row")).join(posted.select("node").unionByName(alike.select("node")).distinct(), "node")
    own = settle(sets(texts.join(row, "row").select("node", "text"), options))
    band = F.shiftright("key", 8 * ROWS)
    before = None
    for turn in (None, band < options.early, band >= options.early):
        bits = turn is None
        waiting = (alike if bits else met(posted.where(turn), nodes)).join(own, "node")
        waiting = waiting.select(*CELL, "side", "root", "fp", "set", "node").repartition(*CELL).sortWithinPartitions(*CELL, "node")
        found = components(decided(waiting, options, bits), "a", "b").select(F.col("node").alias("root"), F.col("root").alias("new"))
        nodes = settle(nodes.join(found, "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new"))
        discard(before)
        before = nodes
    discard(posted)
    discard(alike)
    discard(own)
    return nodes
