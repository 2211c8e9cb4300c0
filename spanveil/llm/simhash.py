"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

A fingerprint has 64 bits: a bit is set if it is set in over half of the XXH64 hashes of the text's word shingles, repeats included.
Two fingerprints that differ in at most t bits differ in at most t of their 8 bytes, so they share at least m = 8 - t positional bytes:
the guaranteed minimum of matches. Lists of single bytes would be too long, so the index posts each distinct fingerprint under all choices of
three of its first seven positions with their bytes: two that share m = 4 of all eight positions share three of any seven, and so a list.
Pairs that meet in a list have their shared positional bytes tallied over all eight; those below the minimum go, and the rest is verified by the differing bits.

``SimHash()`` finds every link. A text may have several fingerprints of different seeds; then a pair is verified over the bits of all of them and
is a candidate if any one shares the minimum. Bits do not reach all of a Jaccard similarity of 0.8; ``similar`` gives the options of ``near``, for ``keep_one``: this method
with an exact check of the shingle sets, and further turns for the links that bits miss.

Copies never form pairs: texts with equal fingerprints are one node before anything is posted. Lists with one member go before any row moves by its key.
A long list (a large group of near copies) is cut into blocks by hash and all pairs of blocks meet in cells, so that no task holds a
whole list and none of its links is lost; a cell returns a forest of its links, not the links, which leaves components as they are.
Components are then found by Spark joins (``graph``). No cap, sample or prefix is used anywhere.

Defined cases: texts without words (null, empty or blank) have fingerprint 0 and link like any other; null doc_ids are
members but never the smallest id, unless a component has no other; repeated rows stay repeated in ``groups`` and one of them stays in ``keep_one``; an empty table gives no
rows; ``keep_one`` keeps every other column, whatever its name; a very long text is read whole, its hashes at 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_arrow, rows_of_bytes, settle, slices, whole_groups
from .graph import components

SEED = 42
#: What names a cell of a list; members of a group whose pairs are formed all at once.
CELL, SMALL = ["key", "lo", "hi"], 16
LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b"     ")


@dataclass(frozen=True)
class SimHash:
    shingle: int = 4
    #: Most differing bits of a link, over all fingerprints.
    bits: int = 4
    #: Least shared positional bytes of one fingerprint.
    matches: int = 4
    #: Positions of a posting, chosen from the first ones: ``matches`` of 8 positions hold ``posted`` of any ``first``.
    posted: int = 3
    seeds: tuple[int, ...] = (SEED,)
    #: Members of a list that are compared in one go; longer lists are cut into blocks.
    block: int = 1024

    @property
    def first(self) -> int:
        return 8 - self.matches + self.posted

    @staticmethod
    def similar(least: float = 0.8, shingle: int = 5, prints: int = 8):
        """Options that link texts by the Jaccard similarity of their shingle sets (``near``)."""
        from .near import Near

        return Near(least, shingle, tuple(range(SEED, SEED + prints)))


def shingle_hashes(text: bytes | None, shingle: int, seed: int = SEED) -> np.ndarray | None:
    """XXH64 of each word shingle, repeats included; None without words."""
    from xxhash import xxh64_intdigest

    words = [w for w in (text or b"").translate(LOWER).split(b" ") if w]
    if not words:
        return None
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    begins = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[len(words) - n :] - 1).tolist()
    return np.fromiter((xxh64_intdigest(joined[i:j], seed) for i, j in zip(begins, stops, strict=True)), np.uint64, n)


def fingerprint(text: bytes | None, shingle: int, seeds: tuple[int, ...] = (SEED,)) -> bytes:
    """The fingerprints of the seeds, 8 bytes each, high bits first."""
    hashes = shingle_hashes(text, shingle, seeds[0])
    if hashes is None:
        return bytes(8 * len(seeds))
    out = []
    for turn, seed in enumerate(seeds):
        if turn:  # further hashes are mixed from the first one
            own = (hashes ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            own = (own ^ (own >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            own ^= own >> np.uint64(32)
        else:
            own = hashes
        out.append(majority(own))
    return b"".join(out)


def majority(hashes: np.ndarray) -> bytes:
    """The bits that are set in over half of the hashes, high bits first."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, options: SimHash) -> DataFrame:
    """doc_id and fp, the fingerprints' bytes."""
    shingle, seeds = options.shingle, options.seeds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [fingerprint(t, shingle, seeds) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, "doc_id long, fp binary")


def postings(nodes: DataFrame, options: SimHash) -> DataFrame:
    """key and node: a key is a hash of ``posted`` positions with their bytes, of one of the fingerprints."""
    choices = list(combinations(range(options.first), options.posted))
    masks = np.array([sum(255 << 8 * b for b in c) for c in choices], np.uint64)
    salts = np.random.default_rng(0).integers(1 << 63, size=(len(options.seeds), len(masks)), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                values = rows_of_bytes(batch.column("fp")).view(">u8").astype(np.uint64)
                keys = (values[:, :, None] & masks) + salts
                keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
                keys ^= keys >> np.uint64(27)
                node = np.repeat(batch.column("node").to_numpy(), salts.size)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], ["key", "node"])

    return map_arrow(nodes.select("node", "fp"), run, "key long, node long")


def verified(x: np.ndarray, y: np.ndarray, options: SimHash) -> np.ndarray:
    """Which pairs are links. x, y: fingerprints' bytes, one row each (or one row for all)."""
    differ = x ^ y
    shared = (differ.reshape(len(differ), differ.shape[1] // 8, 8) == 0).sum(axis=2).max(axis=1)
    return (shared >= options.matches) & (np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= options.bits)


def forest(fps: np.ndarray, node: np.ndarray, side: np.ndarray, options: SimHash) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links of one cell connect.

    side: 0 and 1 for the two blocks, all 0 for a block with itself.
    """
    label = np.arange(len(node))
    two = bool(side.any())
    for i in range(len(fps) - 1):
        later = np.arange(i + 1, len(fps))
        later = later[label[later] != label[i]]
        if two:
            later = later[side[later] != side[i]]
        if not len(later):
            continue
        linked = later[verified(fps[later], fps[i : i + 1], options)]
        if len(linked):
            met = np.unique(np.append(label[linked], label[i]))
            label[np.isin(label, met)] = met[0]
    off = np.flatnonzero(label != np.arange(len(node)))
    return off, label[off]


def small_pairs(begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of groups with at most ``SMALL`` members, in a few large pieces."""
    if not len(sizes):
        return
    place = np.concatenate([np.arange(n) for n in sizes])
    left = np.repeat(sizes, sizes) - place
    rows = np.repeat(begins, sizes) + place
    for step in range(1, int(sizes.max())):
        first = rows[left > step]
        yield first, first + step


def link_lists(cells: DataFrame, options: SimHash) -> DataFrame:
    """a, b: nodes that links of the cells connect. cells: key, lo, hi, side, node, fp, with each cell's rows together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, begins, ends in whole_groups(batches, CELL):
            node, side, fps = part.column("node").to_numpy(), part.column("side").to_numpy(), rows_of_bytes(part.column("fp"))
            small = ends - begins <= SMALL
            seen: set[tuple[int, int]] = set()

            def add(a: np.ndarray, b: np.ndarray, seen=seen) -> None:
                seen.update(zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist(), strict=True))

            for i, j in small_pairs(begins[small], (ends - begins)[small]):
                linked = verified(fps[i], fps[j], options)
                add(node[i[linked]], node[j[linked]])
            for i, j in zip(begins[~small].tolist(), ends[~small].tolist(), strict=True):
                a, b = forest(fps[i:j], node[i:j], side[i:j], options)
                add(node[i + a], node[i + b])
            if seen:
                a, b = zip(*seen, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_arrow(cells, run, "a long, b long")


def shared(posted: DataFrame) -> DataFrame:
    """The postings of keys with two members or more.

    Members are counted by partial aggregation, and only lists that can form a pair are moved by their key; the join has no row order or group
    behind it, so that adaptive execution splits a long list there. Spark takes the postings for as large as the nodes they are made of and
    would broadcast them, so the join is told to merge.
    """
    counted = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return settle(posted.hint("merge").join(counted, "key"))


def cells(members: DataFrame, block: int, budget: int = 8 << 20) -> DataFrame:
    """Lists cut into cells of at most two blocks: the columns of ``members`` and lo, hi, side, each cell's rows together and in order.

    members: key, node, root, weight (bytes), and others. A block has about ``block`` members and ``budget`` bytes; lists of one root are left out, as they can't connect anything.
    """
    lists = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("bytes"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    parts = F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / budget)).cast("int")
    met = members.join(lists.select("key", parts.alias("parts")), "key")
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = (F.col("own") > F.col("other")).cast("int").alias("side")
    cell = met.select(*members.columns, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), side)
    return cell.repartition(*CELL).sortWithinPartitions(*CELL, "node")


def numbered(groups: DataFrame) -> DataFrame:
    """With a column node: a number that a row gets as the table is written."""
    return settle(groups.withColumn("node", F.monotonically_increasing_id()))


def rooted(nodes: DataFrame, options: SimHash) -> DataFrame:
    """The nodes with the root of their component."""
    posted = shared(postings(nodes, options))
    members = posted.join(nodes.select("node", "fp"), "node").select("key", "node", F.col("node").alias("root"), F.lit(0).alias("weight"), "fp")
    found = components(link_lists(cells(members, options.block), options), "a", "b")
    named = settle(nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")))
    discard(posted)
    return named


def groups(docs: DataFrame, options: SimHash = SimHash()) -> DataFrame:
    """doc_id, fingerprint as hex, and component_id: the smallest doc_id that is reachable by links, itself included."""
    marked = settle(fingerprints(docs, options))
    nodes = numbered(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    named = rooted(nodes, options)
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, options=SimHash()) -> DataFrame:
    """The documents with one of each component: a row of its smallest doc_id. options: of ``SimHash`` or ``near.Near``."""
    from . import near

    names, at = docs.columns, docs.columns.index("text")
    alike = isinstance(options, near.Near)
    mark = partial(near.mark, options=options) if alike else partial(fingerprint, shingle=options.shingle, seeds=options.seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names[at]):
            found = [None if t is None else t.encode() for t in batch.column(at).to_pylist()]
            marks = pa.array([mark(t) for t in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], [*names, "__fp"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__fp", T.BinaryType())])
    marked = settle(map_arrow(docs, run, schema).withColumn("__row", F.monotonically_increasing_id()))
    # Of equal fingerprints, and then of each component, the row with the smallest doc_id; among its repeats the first one.
    doc_id = F.col("doc_id").cast("long")
    rank = F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.col("__row").alias("row"))
    nodes = numbered(marked.groupBy(F.col("__fp").alias("fp")).agg(F.min(rank).alias("best")))
    if alike:
        texts = marked.select(F.col("__row").alias("row"), F.col(f"`{names[at]}`").cast("binary").alias("text"))
        named = near.rooted(nodes, texts, options)
    else:
        named = rooted(nodes, options)
    kept = named.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("__row"))
    return marked.join(kept, "__row", "left_semi").select(*[F.col(f"`{c}`") for c in names])
