"""Embedding near-duplicates by sorted projection passes.

Vectors of one label are compared by cosine. Each pass has its own random hyperplanes: the signs of a vector's projections, 64 bits, are its key, and the
vectors are ordered by label and then lexicographically by key, so that vectors at a small angle tend to be neighbours. A row's place in that
order is a number of its own; blocks of ``block`` places are compared within themselves and with the ``window`` rows before them. A row that still
meets a partner in the far half of those rows (a dense group) is open: it goes on to the blocks before, twice as many in each further round, until the
farthest of them holds no partner of it. The candidates of all passes are united, and each pair is verified once by its cosine in double precision, so no link is below the threshold.

Equal vectors are one node with a count before anything is sorted. A pass moves a key, an id, a number for label and length, and a 128-bit sketch of each vector, not the
vector; a sketch leaves out pairs that are far beyond the threshold (about six deviations). The order is dealt out by ranges of the
whole sort key, so no label or key lies in one task. Places, and so blocks and windows, do not depend on those ranges: partitions and reruns give equal links.

The search is approximate by nature: pairs that no pass brings near each other are missed. ``tests/llm`` measures recall against brute force.

Defined cases: vectors that are null, empty, zero, of a null label, or hold null or non-finite components link with nothing, and so do
vectors of different lengths; equal keys stand in order of a digest of the vector; a null vec_id never is a component's id unless it has no other; repeated rows link with each other; an
empty table gives no rows; other columns are not read; a very long vector is held whole, with its hyperplanes (8 kB a component in a worker).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_arrow, settle, whole_groups
from .graph import components

KEY_BITS = 64
SKETCH_BITS = 128


@dataclass(frozen=True)
class Passes:
    least: float = 0.98
    passes: int = 16
    window: int = 64
    block: int = 256
    #: Blocks of open rows that meet a block before them in one task.
    together: int = 16
    seed: int = 5

    @property
    def most_bits(self) -> int:
        """Differing bits of a sketch that a pair at the threshold exceeds about once in a billion."""
        share = np.arccos(self.least) / np.pi
        return int(SKETCH_BITS * share + 6 * np.sqrt(SKETCH_BITS * share * (1 - share)) + 1)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def planes(size: int, options: Passes) -> np.ndarray:
    return np.random.default_rng([options.seed, size]).standard_normal((size, max(options.passes * KEY_BITS, SKETCH_BITS)))


def by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, matrix(batch.column(column).take(pa.array(rows)))


KEYED = "pass int, kind long, key long, tie long, node long, one long, two long"


def keyed(nodes: DataFrame, options: Passes) -> DataFrame:
    """A row for each node and pass: pass, kind (of label and length), key (its unsigned order as a signed number), tie, node, sketch (two numbers)."""
    names = [c.split()[0] for c in KEYED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                for rows, vectors in by_length(batch, 3):
                    size = vectors.shape[1]
                    if size not in known:
                        known[size] = planes(size, options)
                    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
                    bits = np.packbits(scaled @ known[size] > 0, axis=1)
                    keys = np.ascontiguousarray(bits[:, : options.passes * KEY_BITS // 8]).view(">u8").astype(np.uint64) ^ np.uint64(1 << 63)
                    sketch = np.ascontiguousarray(bits[:, : SKETCH_BITS // 8]).view(np.int64)
                    node, kind, tie = (batch.column(k).take(pa.array(rows)) for k in range(3))
                    for k in range(options.passes):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), kind, pa.array(keys[:, k].view(np.int64)), tie, node, pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], names)

    kind = F.xxhash64("label", F.size("vector"))
    return map_arrow(nodes.select("node", kind.alias("kind"), F.col("h").alias("tie"), "vector"), run, KEYED)


def placed(nodes: DataFrame, options: Passes) -> DataFrame:
    """pass, kind, node, one, two and pos, a row's place in the order of all rows; settled."""
    order = [c.split()[0] for c in KEYED.split(", ")][:5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            columns = [*(batch.column(c) for c in ROW), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))]
            yield pa.RecordBatch.from_arrays(columns, [*ROW, "part", "at"])
            at += n

    ordered = keyed(nodes, options).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settle(map_arrow(ordered, run, "pass int, kind long, node long, one long, two long, part int, at long"))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begin = settle(sizes.select("part", F.coalesce(before, F.lit(0)).alias("begin")), 1)
    return rows.join(F.broadcast(begin), "part").select(*ROW, (F.col("begin") + F.col("at")).alias("pos"))


ROW = ["pass", "kind", "node", "one", "two"]
#: Pairs a, b; or b null and the place of an open row.
FOUND = "a long, b long, pos long"


def _found(pairs: list[tuple[np.ndarray, np.ndarray]], open_: list[np.ndarray]) -> pa.RecordBatch:
    a, b, pos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([p[0] for p in pairs], [p[1] for p in pairs], open_))
    columns = [pa.concat_arrays([pa.array(a), pa.nulls(len(pos), pa.int64())]), pa.concat_arrays([pa.array(b), pa.nulls(len(pos), pa.int64())]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(pos)])]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])


class Rows:
    """What is compared of some rows."""

    def __init__(self, batch: pa.RecordBatch):
        self.turn, self.kind, self.node, self.pos, one, two = (batch.column(c).to_numpy() for c in ("pass", "kind", "node", "pos", "one", "two"))
        self.sketch = np.column_stack((one, two)).view(np.uint64)  # as signed numbers they are the same bits

    def near(self, x: slice, y: slice, most_bits: int) -> np.ndarray:
        """A matrix: which rows x and y are of one pass and kind, with near sketches."""
        bits = np.bitwise_count(self.sketch[x, None] ^ self.sketch[None, y]).sum(axis=2)
        return (bits <= most_bits) & (self.turn[x, None] == self.turn[None, y]) & (self.kind[x, None] == self.kind[None, y])


def block_of(pos: Column, options: Passes) -> Column:
    return F.floor(pos / options.block).cast("long")


def neighbours(rows: DataFrame, options: Passes) -> DataFrame:
    """Pairs within blocks and with the rows carried over from the block before, and the open rows."""
    block = block_of(F.col("pos"), options)
    carried = rows.where(F.col("pos") % options.block >= options.block - options.window).withColumn("cell", block + 1)
    cells = rows.withColumn("cell", block).unionByName(carried).repartition("cell").sortWithinPartitions("cell", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, begins, ends in whole_groups(batches, ["cell"], 1 << 20):
            held, cell = Rows(part), part.column("cell").to_numpy()
            pairs, open_ = [], []
            for i, j in zip(begins.tolist(), ends.tolist(), strict=True):
                first = i + int((held.pos[i:j] < cell[i] * options.block).sum())
                near = np.tril(held.near(slice(first, j), slice(i, j), options.most_bits), first - i - 1)
                x, y = np.nonzero(near)
                pairs.append((held.node[first + x], held.node[i + y]))
                open_.append(held.pos[first:j][near[:, : (first - i) // 2].any(axis=1)])
            yield _found(pairs, open_)

    return map_arrow(cells.select("cell", *ROW, "pos"), run, FOUND)


def farther(rows: DataFrame, open_: DataFrame, span: int, options: Passes) -> DataFrame:
    """Pairs of the open rows with those of the blocks from ``span`` before theirs to one less than twice that, and the rows that stay open."""
    own, last = block_of(F.col("pos"), options), 2 * span - 1
    asking = rows.join(open_, "pos").withColumn("own", own).where(F.col("own") >= span)
    asking = asking.withColumn("cell", F.explode(F.sequence(F.greatest(F.col("own") - last, F.lit(0)), F.col("own") - span)))
    asking = asking.withColumn("group", F.floor(F.col("own") / options.together).cast("long")).withColumn("side", F.lit(1)).drop("own")
    asked = rows.withColumn("cell", own).join(asking.select("cell", "group").distinct(), "cell").withColumn("side", F.lit(0))
    order = ["cell", "group"]
    cells = asking.unionByName(asked).select(*order, "side", *ROW, "pos").repartition(*order).sortWithinPartitions(*order, "side", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, begins, ends in whole_groups(batches, order, 1 << 20):
            held, cell, side = Rows(part), part.column("cell").to_numpy(), part.column("side").to_numpy()
            for i, j in zip(begins.tolist(), ends.tolist(), strict=True):
                first = i + int((side[i:j] == 0).sum())
                for at in range(first, j, 512):
                    near = held.near(x := slice(at, min(at + 512, j)), slice(i, first), options.most_bits)
                    a, b = np.nonzero(near)
                    pos = held.pos[x]
                    yield _found([(held.node[x][a], held.node[i + b])], [pos[near.any(axis=1) & (pos // options.block - last == cell[i])]])

    return map_arrow(cells, run, FOUND)


def candidates(rows: DataFrame, options: Passes) -> DataFrame:
    """a, b: every pair of nodes once, from windows that go on while they find partners."""
    found, span = [settle(neighbours(rows, options))], 1
    while True:
        open_ = found[-1].where("b is null").select("pos")
        if open_.isEmpty():
            break
        found.append(settle(farther(rows, open_, span, options)))
        span *= 2
    pairs = reduce(DataFrame.unionByName, found).where("b is not null AND a <> b")
    done = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for x in found:
        discard(x)
    return done


def verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs of one label and length with a cosine of at least ``least`` in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                x, y = (matrix(batch.column(c).take(pa.array(rows))) for c in (2, 3))
                x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
                dot = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                keep[rows] = dot >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    one = nodes.select(F.col("node").alias("a"), F.col("label").alias("k"), F.col("vector").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("label").alias("m"), F.col("vector").alias("y"))
    both = pairs.join(one, "a").join(two, "b").where((F.col("k") == F.col("m")) & (F.size("x") == F.size("y")))
    return map_arrow(both.select("a", "b", "x", "y"), run, "a long, b long")


def links(vectors: DataFrame, options: Passes = Passes(), key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector."""
    spark = vectors.sparkSession
    data = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    digest = F.when(valid, F.struct(F.xxhash64("label", "vector").alias("h"), F.xxhash64(F.lit(1), "vector", "label").alias("g")))
    data = data.withColumn("h", digest["h"]).withColumn("g", digest["g"])
    # Equal vectors are one node; it gets its number as the table is written.
    grouped = data.where(F.col("h").isNotNull()).groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    nodes = settle(grouped.withColumn("node", F.monotonically_increasing_id()))
    pairs = candidates(placed(nodes.select("node", "h", "label", "vector"), options), options)
    edges = settle(verified(pairs, nodes.select("node", "label", "vector"), options.least))
    discard(pairs)
    root = components(edges, "a", "b")
    size = nodes.select(F.col("node").alias("b"), "n")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(size, "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    known = nodes.select("h", "g", "n", "first_id", "node").join(degree, "node", "left").join(root, "node", "left")
    known = known.select("h", "g", "first_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    smallest = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = known.join(smallest, "root").select("h", "g", "n_links", "component_id")
    linked = data.where(F.col("h").isNotNull()).select("vec_id", "h", "g").join(known, ["h", "g"]).select("vec_id", "n_links", "component_id")
    alone = data.where(F.col("h").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(False))
    return linked.withColumn("n_links", F.col("n_links").cast("long")).unionByName(alone).withColumn("kept", kept)
