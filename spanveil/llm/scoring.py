"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every token from both of its sides.

A document's score is the sum of log p(token | ``side`` tokens on the left, ``side`` on the right) over all of its tokens, each masked in turn.

Tokens: the ``vocabulary`` most frequent words of the whole corpus are tokens; any other word is spelled in pieces, by rule: two letters a to z, or a byte, those at
a word's beginning apart from the others. So every text is tokens of a closed set, and none is left out or pooled. The network is an embedding of the context tokens, a hidden layer, and a binary decision at
each inner node of a Huffman tree over the tokens, built from their counts; the decisions on the way to a token give its probability,
and those of all tokens add up to 1. The heaviest ``TOP`` nodes, where most decisions fall, are computed as one matrix product. Before training the decisions follow the counts, so training begins at the unigram model.

Training is data-parallel and covers every token of every document once. A digest of its id and tokens gives a document a round, a shard and a place in it (so copies spread over the shards); the number
of shards follows the number of tokens. In a round each shard starts from the common parameters and goes through its own tokens by gradient steps, in which the gradients of a
token that occurs several times add up; its changed rows are then averaged with those of other shards that changed them too, summed exactly as integers. None of this
depends on partitions: any layout of the same rows gives the same scores. The driver holds word counts of the vocabulary and one set of parameters, both of fixed size.

Defined cases: a null, empty or wordless text has 0 words, score 0 and null means; repeated rows stay repeated and score alike; ties of equally frequent words fall to the
smaller word; a null doc_id stays null; an empty table gives no rows; other columns are not read; a very long text is read whole, at two bytes a token, and scored in pieces that see
across their edges.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, distinct, map_arrow, parted, settle, slices, strung, text_ends

#: ASCII signs and white space part words; letters are lowered and bytes of other characters stay.
PARTING = bytes(32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Pieces that spell: two letters or a byte; those of a word's beginning come first, then the same for the rest of a word.
PAIRS = 26**2
PIECES = PAIRS + 256
SPELLING = 2 * PIECES
#: Nodes of the tree whose decisions are computed for all tokens at once; numbers of a unit; tokens that are scored at once; numbers of a shuffled row.
TOP, UNIT, ROWS, BLOCK = 32, 1 << 20, 2048, 1 << 12


@dataclass(frozen=True)
class Scoring:
    vocabulary: int = 61440
    side: int = 2
    width: int = 8
    hidden: int = 8
    #: Shares of the documents that train in each round; their sum is 1.
    rounds: tuple[float, ...] = (0.125, 0.375, 0.5)
    #: Tokens of a shard, of a stretch whose order is mixed, and of a gradient step.
    shard: int = 1 << 21
    stretch: int = 1 << 16
    batch: int = 2048
    step: float = 0.2
    seed: int = 11


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(PARTING).split()


def words_in(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of a column of texts the distinct words, each word's place among them, and how many words each text has."""
    words, counts = parted([(text or b"").translate(PARTING) for text in column.to_pylist()])
    return *distinct(words), counts


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n: of all words of all documents; counted on the executors before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out() -> list[pa.RecordBatch]:
            whole = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            held.clear()
            return whole.rename_columns({"n_sum": "n"}).to_batches(1 << 16)

        for batch in slices(batches, "text"):
            words, at, _ = words_in(batch.column("text"))
            held.append(pa.table({"word": words, "n": np.bincount(at, minlength=len(words)).astype(np.int64)}))
            if sum(t.num_rows for t in held) > 400_000:
                yield from out()
        if held:
            yield from out()

    return map_arrow(texts, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pieces of words, among the ``SPELLING`` ones, and how many each word has. Letters that stand together go by pairs."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset) if len(words) else np.zeros(1, np.int32)
    begin, size = offsets[:-1] - offsets[0], int(offsets[-1] - offsets[0])
    raw = np.frombuffer(words.buffers()[2], np.uint8, size, int(offsets[0])).astype(np.int32) if size else np.zeros(0, np.int32)
    first = np.zeros(size + 1, bool)
    first[begin] = True
    letter = np.append((raw >= 97) & (raw <= 122), False)
    run = letter & first
    run[1:] |= letter[1:] & ~letter[:-1]
    at = np.arange(size + 1)
    even = (at - np.maximum.accumulate(np.where(run, at, 0))) % 2 == 0
    stands = (~letter | even)[:-1]
    pair = stands & letter[:-1] & letter[1:] & ~first[1:]
    number = PAIRS + raw
    two = np.flatnonzero(pair)
    number[two] = (raw[two] - 97) * 26 + raw[two + 1] - 97
    number[~first[:-1]] += PIECES
    ends = np.append(0, np.cumsum(stands))
    return number[stands], ends[begin + np.diff(offsets)] - ends[begin]


def spelled_counts(words: DataFrame) -> np.ndarray:
    """How often each spelling piece occurs in the words, n times each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SPELLING, np.int64)
        for batch in batches:
            found, size = spelled(batch.column("word"))
            np.add.at(total, found, np.repeat(batch.column("n").to_numpy(), size))
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), pa.array(total[places])], ["token", "n"])

    out = np.zeros(SPELLING, np.int64)
    for row in map_arrow(words.select("word", "n"), run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():  # at most SPELLING
        out[row["token"]] = row["n"]
    return out


def vocabulary(counted: DataFrame, options: Scoring) -> tuple[list[bytes], np.ndarray]:
    """The frequent words, and the counts of all tokens: of these words, then of the spelling ones."""
    top = counted.orderBy(F.desc("n"), "word").limit(options.vocabulary).collect()  # bounded by the vocabulary
    if not top:
        return [], np.zeros(SPELLING, np.int64)
    words, least = [bytes(r["word"]) for r in top], top[-1]
    others = counted.where((F.col("n") < least["n"]) | ((F.col("n") == least["n"]) & (F.col("word") > F.lit(bytes(least["word"])))))
    return words, np.concatenate(([r["n"] for r in top], spelled_counts(others)))


def numbered(words: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of words, one word after the other, and how many each has: its place in the vocabulary, or its pieces behind that."""
    place = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy()
    odd = place < 0
    own, sizes = spelled(words.filter(pa.array(odd)))
    size = np.ones(len(words), np.int64)
    size[odd] = sizes
    flat = np.repeat(place, size)
    flat[np.repeat(odd, size)] = own + len(vocabulary)
    return flat.astype(np.uint16), size


def encoded(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """doc_id, n_words, n (tokens), ids (two bytes a token)."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(shared.value, pa.binary())
        for batch in slices(batches, "text", 4 << 20):
            words, at, counts = words_in(batch.column("text"))
            ids, ends = strung(at, *numbered(words, vocabulary))
            ends = text_ends(ends, counts)
            texts = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(np.diff(ends)), texts], ["doc_id", "n_words", "n", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_arrow(texts, run, "doc_id long, n_words long, n long, ids binary")


@dataclass
class Ways:
    """Decisions on the way to each token: token t's are ``depth[t]`` ones from ``begin[t]`` on, at ``node`` with ``sign`` 1 or -1."""

    depth: np.ndarray
    node: np.ndarray
    sign: np.ndarray

    def __post_init__(self):
        self.begin = np.cumsum(self.depth) - self.depth
        self.rank = (self.depth.max(initial=0) - self.depth).astype(np.uint16)

    def order(self, tokens: np.ndarray) -> np.ndarray:
        """The tokens' places by falling depth: those with a decision of any level then stand first."""
        return np.argsort(self.rank.take(tokens), kind="stable")

    def levels(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Node and sign of the first decisions of all tokens, which stand in that order, then of the second ones and so on; and how many each level has."""
        sizes = (len(tokens) - np.cumsum(np.bincount(self.depth.take(tokens)))[:-1]).tolist()
        begin = self.begin.take(tokens)
        at = joined([begin[:n] + k for k, n in enumerate(sizes)]) if sizes else begin[:0]
        return self.node.take(at).astype(np.intp), self.sign.take(at), sizes


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts, axis=-1)


def spread(columns: np.ndarray, sizes: list[int]) -> np.ndarray:
    """For each decision, level by level, its token's column."""
    return joined([columns[:, :n] for n in sizes])


def gathered(values: np.ndarray, sizes: list[int], out: np.ndarray) -> None:
    """Adds to each token's number (or column) those of its decisions."""
    first = 0
    for n in sizes:
        out[..., :n] += values[..., first : first + n]
        first += n


class Tree:
    """A Huffman tree. Nodes are numbered from the heaviest, the root, on; ways are parted into those at the first ``TOP`` nodes and those below."""

    def __init__(self, numbers: np.ndarray):
        weights = (numbers + 1).tolist()
        self.tokens = tokens = len(weights)
        heap = [(w, t) for t, w in enumerate(weights)]
        heapq.heapify(heap)
        up, side = [0] * (2 * tokens - 1), [0] * (2 * tokens - 1)
        self.bias = np.zeros(tokens - 1)
        root = 2 * tokens - 2
        for inner in range(tokens, root + 1):
            (small, a), (large, b) = heapq.heappop(heap), heapq.heappop(heap)
            up[a], up[b], side[a], side[b] = inner, inner, 1, -1
            self.bias[root - inner] = np.log(small / large)
            heapq.heappush(heap, (small + large, inner))
        self.heavy = min(TOP, tokens - 1)
        found: tuple[list, list] = ([], [])
        depth = np.zeros((2, tokens), np.int64)
        for token in range(tokens):
            at = token
            while at != root:
                node = root - up[at]
                part = int(node >= self.heavy)
                found[part].append((node, side[at]))
                depth[part, token] += 1
                at = up[at]
        self.top, self.below = (Ways(d, np.array([n for n, _ in f], np.uint16), np.array([x for _, x in f], np.float32)) for d, f in zip(depth, found, strict=True))
        #: Of each token its signs at all of the first nodes, 0 where its way does not pass.
        self.signs = np.zeros((tokens, self.heavy), np.int8)
        self.signs[np.repeat(np.arange(tokens), depth[0]), self.top.node] = self.top.sign

    def whole(self) -> Ways:
        """The ways from the root on."""
        parts = (self.top, self.below)
        depth = self.top.depth + self.below.depth
        out = Ways(depth, np.empty(depth.sum(), np.uint16), np.empty(depth.sum(), np.float32))
        for part, begin in zip(parts, (out.begin, out.begin + self.top.depth), strict=True):
            at = np.repeat(begin - part.begin, part.depth) + np.arange(len(part.node))
            out.node[at], out.sign[at] = part.node, part.sign
        return out


def contexts(ids: np.ndarray, side: int, pad: int) -> np.ndarray:
    """For each token the numbers of ``side`` tokens on the left and on the right."""
    wide = np.concatenate((np.full(side, pad), ids, np.full(side, pad)))
    n = len(ids)
    return np.stack([wide[k : k + n] for k in range(2 * side + 1) if k != side], axis=1)


def added(rows: np.ndarray, columns: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, of ``count``, and the sums of their values, which are given and returned as columns."""
    place, own = np.empty(count, np.intp), np.arange(len(rows))
    place[rows] = own
    found = rows.take(np.flatnonzero(place.take(rows) == own))  # where a row stands last
    place[found] = own[: len(found)]
    places = place.take(rows)
    out = np.empty((len(columns), len(found)), columns.dtype)
    for k, column in enumerate(columns.astype(np.float64)):
        out[k] = np.bincount(places, column, len(found))
    return found, out


def with_one(h: np.ndarray) -> np.ndarray:
    """The columns of the hidden layer and a last one of ones, which a node's bias is multiplied by."""
    out = np.ones((h.shape[1] + 1, len(h)), h.dtype)
    out[:-1] = h.T
    return out


def put_rows(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """table[rows] = values, a row as one item."""
    item = np.dtype((np.void, table.dtype.itemsize * table.shape[1]))
    table.view(item).ravel()[rows] = values.view(item).ravel()


def pulled(logit: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """The loss's derivative by the logit."""
    out = logit * sign
    np.exp(np.minimum(out, 60, out=out), out=out)
    out += 1
    np.divide(sign, out, out=out)
    return np.negative(out, out=out)


class Network:
    """Parts: embeddings of the context; weights and bias of the hidden layer; of each node its weights and, as the last column, its bias."""

    TABLES = (0, 3)

    def __init__(self, tree: Tree, options: Scoring):
        self.tree, self.options, self.pad = tree, options, tree.tokens
        draw = np.random.default_rng(options.seed)
        inputs = 2 * options.side * options.width
        embedding = 0.5 * draw.standard_normal((self.pad + 1, options.width))
        weights = draw.standard_normal((inputs, options.hidden)) / np.sqrt(inputs)
        nodes = np.concatenate((np.zeros((self.pad - 1, options.hidden)), tree.bias[:, None]), axis=1)
        self.parts = [x.astype(np.float32) for x in (embedding, weights, np.zeros(options.hidden), nodes)]
        self.begin()

    def begin(self) -> None:
        """Nothing has been learnt since: squares of gradients, by row in the tables, and which rows have changed."""
        self.squares = [np.full(len(p) if i in self.TABLES else p.shape, 0.1, np.float32) for i, p in enumerate(self.parts)]
        self.changed = [np.zeros(len(self.parts[i]), bool) for i in self.TABLES]

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e, w, b, _ = self.parts
        x = e.take(context, axis=0).reshape(len(context), -1)
        return x, np.tanh(x @ w + b)

    def gradients(self, context: np.ndarray, target: np.ndarray) -> list:
        """Of the loss summed over a batch: (rows, values) of the tables, arrays of the other parts."""
        e, w, _, v = self.parts
        order = self.tree.below.order(target)
        context, target = context.take(order, axis=0).astype(np.intp), target.take(order)
        x, h = self.hidden(context)
        ones = with_one(h)
        top = v[: self.tree.heavy]
        sign = self.tree.signs.take(target, axis=0).astype(v.dtype)
        pull = pulled(ones.T @ top.T, sign)
        back = np.ascontiguousarray((pull @ top[:, :-1]).T)
        met = np.flatnonzero(ones[-1] @ (sign * sign))
        rows, values = [met], [(ones @ pull).take(met, axis=1)]
        node, sign, sizes = self.tree.below.levels(target)
        if sizes:
            own, known = np.ascontiguousarray(v.take(node, axis=0).T), spread(ones, sizes)
            pull = pulled(np.einsum("ji,ji->i", own, known), sign)
            own *= pull
            gathered(own[:-1], sizes, back)
            known *= pull
            found = added(node, known, len(v))
            rows.append(found[0])
            values.append(found[1])
        back *= 1 - ones[:-1] ** 2
        width = e.shape[1]
        by_column = w.reshape(-1, width, w.shape[1]).swapaxes(0, 1).reshape(w.shape)
        beside, inward = added(context.T.ravel(), (by_column @ back).reshape(width, -1), len(e))
        return [(beside, inward.T), (back @ x).T, back.sum(axis=1), (np.concatenate(rows), joined(values).T)]

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        """A step against the gradients, each divided by the root of the squares so far (of a row of a table: their mean)."""
        for i, (part, squares, gradient) in enumerate(zip(self.parts, self.squares, self.gradients(context, target), strict=True)):
            if i in self.TABLES:
                rows, values = gradient
                so_far = squares.take(rows) + np.einsum("ij,ij->i", values, values) / values.shape[1]
                squares[rows] = so_far
                new = part.take(rows, axis=0)
                new -= np.ascontiguousarray((values.T * (self.options.step / np.sqrt(so_far))).T)
                put_rows(part, rows, new)
                self.changed[self.TABLES.index(i)][rows] = True
            else:
                squares += gradient * gradient
                part -= self.options.step / 10 * gradient / np.sqrt(squares)

    def answer(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of all numbers that have changed, as integers."""
        places, values, base, tables = [], [], 0, iter(self.changed)
        for i, part in enumerate(self.parts):
            width = part.shape[1] if i in self.TABLES else 1
            rows = np.flatnonzero(next(tables)) if i in self.TABLES else np.arange(part.size)
            places.append((base + rows[:, None] * width + np.arange(width)).ravel())
            values.append(np.rint(np.clip(part.reshape(-1, width)[rows], -64, 64).astype(np.float64) * UNIT).astype(np.int64).ravel())
            base += part.size
        return np.concatenate(places), np.concatenate(values)

    def take(self, blocks: list[tuple[int, np.ndarray]]) -> None:
        """Numbers from a place on; those that are not a number leave what stands there."""
        flat = np.concatenate([p.ravel() for p in self.parts])
        for begin, values in blocks:
            np.copyto(flat[begin : begin + len(values)], values, casting="same_kind", where=~np.isnan(values))
        at = 0
        for i, part in enumerate(self.parts):
            self.parts[i] = flat[at : at + part.size].reshape(part.shape).copy()
            at += part.size


def dealt(coded: DataFrame, options: Scoring) -> tuple[DataFrame, list[int]]:
    """turn, shard, place and ids of each document with tokens, and the number of shards of each round."""
    edges = np.cumsum(options.rounds)[:-1].tolist()
    drawn = F.pmod(F.xxhash64(F.lit("round"), "doc_id", "ids"), F.lit(1 << 30)) / float(1 << 30)
    turn = sum(((drawn >= e).cast("int") for e in edges), F.lit(0)).alias("turn")
    own = coded.where("n > 0").select("doc_id", "ids", "n", turn)
    sizes = {r["turn"]: r["n"] for r in own.groupBy("turn").agg(F.sum("n").alias("n")).collect()}  # a row a round
    shards = [-(-sizes.get(k, 0) // options.shard) for k in range(len(options.rounds))]
    count = F.element_at(F.array(*[F.lit(max(1, s)) for s in shards]), F.col("turn") + 1)
    return own.select("turn", F.pmod(F.xxhash64(F.lit("shard"), "doc_id", "ids"), count).alias("shard"), F.xxhash64("doc_id", "ids").alias("place"), "ids"), shards


def stretches(documents: Iterator[np.ndarray], options: Scoring, pad: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contexts and tokens of the batches of a shard: every ``stretch`` tokens are mixed and then cut."""
    held, count = [], 0

    def cut(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal held, count
        whole = np.concatenate(held)
        held, count = [whole[n:]], len(whole) - n
        mixed = whole[:n][np.random.default_rng(options.seed).permutation(n)]
        for at in range(0, n, options.batch):
            yield mixed[at : at + options.batch, :-1], mixed[at : at + options.batch, -1]

    for ids in documents:
        for at in range(0, len(ids), options.stretch):  # a long document comes in pieces, with what stands beside them
            left, right = max(0, at - options.side), at + options.stretch + options.side
            piece = contexts(ids[left:right], options.side, pad)[at - left : at - left + options.stretch]
            held.append(np.column_stack((piece, ids[at : at + options.stretch])))
            count += len(piece)
            while count >= options.stretch:
                yield from cut(options.stretch)
    if count:
        yield from cut(count)


def train(coded: DataFrame, numbers: np.ndarray, options: Scoring) -> Network:
    tree = Tree(numbers)
    network = Network(tree, options)
    context = coded.sparkSession.sparkContext
    documents, shards = dealt(coded, options)
    for turn, count in enumerate(shards):
        if not count:
            continue
        start = context.broadcast(network)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            own, total, count = copy(start.value), None, None
            for shard in by_shard(batches):
                own.parts = [p.copy() for p in start.value.parts]
                own.begin()
                for x, y in stretches(shard, options, own.pad):
                    own.learn(x, y)
                if total is None:  # the shards of a task are summed up here
                    total, count = (np.zeros(sum(p.size for p in own.parts), np.int64) for _ in range(2))
                places, values = own.answer()
                total[places] += values
                count[places] += 1
            for at in range(0, 0 if total is None else len(total), BLOCK):
                part = slice(at, at + BLOCK)
                if count[part].any():
                    yield pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "value": [total[part].tobytes()], "shards": [count[part].astype(np.int32).tobytes()]})

        mine = documents.where(F.col("turn") == turn).select("shard", "place", "ids")
        mine = mine.repartition("shard").sortWithinPartitions("shard", "place", "ids")
        found = map_arrow(map_arrow(mine, run, BLOCKS).repartition("block"), averaged, "block int, value binary").toArrow()  # bounded by the parameters
        network.take([(k, np.frombuffer(x)) for k, x in zip(*(c.to_pylist() for c in found.columns), strict=True)])
        start.unpersist()
    return network


#: ``BLOCK`` numbers in a row, from place ``block`` on: 64-bit sums, and by how many shards (32-bit).
BLOCKS = "block int, value binary, shards binary"


def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the means over the shards, as doubles; not a number where no shard has changed a number."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, value, shards in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = np.frombuffer(value, np.int64), np.frombuffer(shards, np.int32)
            for total, own in zip(sums.setdefault(block, [np.zeros_like(x) for x in found]), found, strict=True):
                total += own
    for block, (value, shards) in sums.items():
        mean = np.divide(value, shards, out=np.full(len(value), np.nan), where=shards > 0) / UNIT
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "value": [mean.tobytes()]})


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[np.ndarray]]:
    """The documents of each shard, one shard after the other; a shard is read as it trains."""
    rows = ((s, ids) for b in batches for s, ids in zip(b.column("shard").to_pylist(), b.column("ids"), strict=True))
    row = next(rows, None)

    def documents(shard: int) -> Iterator[np.ndarray]:
        nonlocal row
        while row is not None and row[0] == shard:
            yield np.frombuffer(row[1].as_buffer(), np.uint16).astype(np.int32)
            row = next(rows, None)

    while row is not None:
        yield documents(row[0])


class Scorer:
    """The trained model with the first layer's products tabulated for each token and place."""

    def __init__(self, network: Network):
        e, w, self.b, self.nodes = network.parts
        self.side, width, self.ways, self.pad = network.options.side, network.options.width, network.tree.whole(), network.pad
        self.tables = [e @ w[k * width : (k + 1) * width] for k in range(2 * self.side)]

    def log_probabilities(self, texts: Sequence[np.ndarray]) -> list[float]:
        """The sum of each text's log-probabilities. A token's is computed apart from the others, so texts beside each other don't matter."""
        gap = np.full(self.side, self.pad)
        wide = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
        size = np.array([len(t) for t in texts])
        begin = np.cumsum(size + self.side) - size
        at = np.concatenate([np.arange(b, b + n) for b, n in zip(begin, size, strict=True)])
        out = np.empty(len(at))
        for first in range(0, len(at), ROWS):
            own = at[first : first + ROWS]
            order = self.ways.order(wide.take(own))
            own = own.take(order)
            h = np.tile(self.b, (len(own), 1))
            for k, table in zip((k for k in range(-self.side, self.side + 1) if k), self.tables, strict=True):
                h += table.take(wide.take(own + k), axis=0)
            node, sign, sizes = self.ways.levels(wide.take(own))
            logit = np.ascontiguousarray(self.nodes.take(node, axis=0).T)
            logit *= spread(with_one(np.tanh(h, out=h)), sizes)
            total = np.zeros(len(own))
            gathered(losses(logit.sum(axis=0) * sign), sizes, total)
            out[first + order] = -total
        sums = np.concatenate(([0], np.cumsum(size)))
        return [float(out[a:b].sum()) for a, b in zip(sums[:-1].tolist(), sums[1:].tolist(), strict=True)]


def losses(logit: np.ndarray) -> np.ndarray:
    """log(1 + exp(-logit)), of any size."""
    small = np.abs(logit)
    np.log1p(np.exp(np.negative(small, out=small), out=small), out=small)
    small -= np.minimum(logit, 0)
    return small


SCORES = "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double, perplexity double"


def score(docs: DataFrame, options: Scoring = Scoring()) -> DataFrame:
    """The pseudo-log-likelihood of each document under a model of all documents; means and perplexities are by word."""
    counted = settle(word_counts(docs.select(F.col("text").cast("binary").alias("text"))))
    words, numbers = vocabulary(counted, options)
    discard(counted)
    coded = settle(encoded(docs, words))
    network = train(coded, numbers, options)
    model = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in slices(batches, "ids", 1 << 17):
            texts = [np.frombuffer(x.as_buffer(), np.uint16).astype(np.int32) for x in batch.column("ids")]
            n_words = batch.column("n_words").to_pylist()
            sums = [round(x, 4) for x in scorer.log_probabilities(texts)]
            means = [round(s / n, 6) if n else None for s, n in zip(sums, n_words, strict=True)]
            perplexity = [None if m is None else round(float(np.exp(min(-m, 700.0))), 4) for m in means]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(sums, pa.float64()), pa.array(means, pa.float64()), pa.array(perplexity, pa.float64())], [x.split()[0] for x in SCORES.split(", ")])

    return map_arrow(coded.select("doc_id", "n_words", "ids"), run, SCORES)
