"""Packing documents into training sequences: order-preserving dynamic programming over document and sentence boundaries.

The documents of a partition, in their order, form one stream of token ids. Cuts may fall after a document, after a sentence, or
(dearly) inside one; a window between two cuts is a sequence of at most ``size`` ids. The programme minimises

    padding of every sequence + ``sentence_cut`` per cut inside a document + ``word_cut`` per cut inside a sentence.

Padding is linear in a window's length, so the best earlier cut is a minimum over a sliding window of positions, kept in a monotone
queue: each position enters and leaves once. A sequence whose length is a power of two needs no padding; the last, shorter window of
a partition is therefore written as its binary digits where that is cheaper than padding it.

Only the scan's partitions are used: nothing is shuffled, and a lost executor repeats its partitions with equal results. Memory is
bounded by a block of ``block`` ids and the longest document. A sequence id is the partition's number and a running number in it.

Defined cases: of cuts that are equally dear the earliest position in the queue counts, so reruns agree; a very long text is tokenised word by word and cut like any other; a null or empty text is the end id alone; equal rows are packed once each; a null doc_id is packed and stays null; an
empty table gives no rows; other columns are not read, so that their names can't clash.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, listed, map_arrow, parted, slices, strung, text_ends

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
#: Bits of a sequence id below the partition's number.
LOCAL_BITS = 36


@dataclass(frozen=True)
class Packing:
    size: int = 4096
    end_id: int = 2
    sentence_cut: float = 6.0
    word_cut: float = 48.0
    block: int = 1 << 20
    #: Words whose ids are kept at hand in each worker: those of late, in two generations.
    remembered: int = 800_000


class Words:
    """The ids of texts, from ids of white-space separated words: the tokenizer drops white space and never merges across it.

    The distinct words of a stretch of texts are looked up, if they came before, so that the tokenizer sees each frequent word about once and no long text as a whole. Of the two
    generations of known words the older one goes when the younger one is full; a word that is met again moves up before.
    """

    #: Signs: the tokenizer parts those behind a word's last plain letter in any case.
    SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
    #: Bytes of letters up to U+00FF in UTF-8, and of some other signs that are no letters.
    WESTERN = bytes([*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC2, 0xC3])
    BLANK = bytes.maketrans(b"\t\r\n\x0b\x0c", b"     ")
    LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\t\r\n\x0b\x0c", bytes(range(97, 123)) + b"     ")

    def __init__(self, path: str, remembered: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.remembered = remembered
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        #: Of each id whether it ends a word.
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.ends = np.array(sorted({i for i in map(self.tokenizer.token_to_id, (".</w>", "!</w>", "?</w>")) if i is not None}), dtype=np.uint32)

    def learn(self, words: list[bytes]) -> None:
        """A word's signs at the end are parted from its letters first, so that few distinct words are left to ask for."""
        known, older, signs = self.known, self.older, self.SIGNS
        parted, own = [], set()
        for word in words:
            stem = word.rstrip(signs)
            if stem != word and b"a" <= stem[-1:] <= b"z" and b"<|" not in word:
                tail = word[len(stem) :]
                parted.append((word, stem, tail))
                own.add(stem)
                own.add(tail)
            else:
                own.add(word)
        own.difference_update(known)
        met = own.intersection(older)
        known.update((w, older[w]) for w in met)
        self.ask([w for w in own if w not in met])
        for word, stem, tail in parted:
            known[word] = known[stem] + known[tail]

    def ask(self, words: list[bytes]) -> None:
        """Plain lower-case words go to the tokenizer's model as they are; other words go through its whole chain, those of letters up to U+00FF many at a time."""
        tokenize, known = self.model.tokenize, self.known
        western, odd = [], []
        for word in words:
            if word.isalpha():  # of bytes: ASCII letters only
                known[word] = array("I", [t.id for t in tokenize(word.decode().lower())]).tobytes()
            elif not word.translate(None, self.WESTERN) and word.decode().isalpha():
                western.append(word)
            else:
                odd.append(word)
        for at in range(0, len(western), 4096):
            odd += self.together(western[at : at + 4096])
        for at in range(0, len(odd), 1024):
            part = odd[at : at + 1024]
            for word, found in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                known[word] = np.array(found.ids, dtype="<u4").tobytes()

    def together(self, words: list[bytes]) -> list[bytes]:
        """Words of letters only, parted where ids end a word; the words are returned if that is not once in each."""
        lines = [b" ".join(words[k : k + 512]).decode() for k in range(0, len(words), 512)]
        ids = np.concatenate([np.array(found.ids, dtype="<u4") for found in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
        if len(ends) != len(words) or ends[-1] != ids.nbytes:
            return words
        whole, begin = ids.tobytes(), 0
        for word, end in zip(words, ends.tolist(), strict=True):
            self.known[word] = whole[begin:end]
            begin = end
        return []

    def spaced(self, text: bytes) -> bytes:
        """Special tokens are found before letters are lowered, so a text that may hold one keeps its letters."""
        return text.translate(self.BLANK if b"<|" in text else self.LOWER)

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, as little-endian 32-bit numbers."""
        words, counts = parted([self.spaced(t) for t in texts])
        words, at = distinct(words)
        words = listed(words)
        if len(self.known) > self.remembered // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [w for w in words if w not in known]
        known.update((w, older[w]) for w in new if w in older)
        self.learn([w for w in new if w not in older])
        numbers = [known[w] for w in words]
        size = np.fromiter(map(len, numbers), np.int64, len(numbers)) // 4
        flat, ends = strung(at, np.frombuffer(b"".join(numbers), "<u4"), size)
        ends = text_ends(ends, counts).tolist()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def cuts(ends: np.ndarray, costs: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """The cheapest cut positions of a stream, its last position excluded from none.

    ends: increasing positions at which a cut is allowed, the last is the stream's end and gaps are at most ``size``; costs: of a cut
    at each. The last window isn't charged for padding: its caller carries it over or writes it by binary digits.
    """
    n = len(ends)
    place, cost = ends.tolist(), costs.tolist()
    best = [0.0] * (n + 1)
    back = [0] * (n + 1)
    where = [0, *place]
    queue: deque[int] = deque([0])
    value = [0.0] * (n + 1)  # best cost so far less what the position saves in padding
    exact: dict[int, int] = {0: 0}
    powers = [1 << k for k in range(size.bit_length() - 1)]
    powers = powers[max(0, len(powers) - 3) :]
    for j in range(1, n + 1):
        at = where[j]
        while where[queue[0]] < at - size:
            queue.popleft()
        i = queue[0]
        least = value[i] + size - at if j < n else min(best[k] for k in queue)
        if j == n:
            i = min(queue, key=best.__getitem__)
        for power in powers:  # windows of such a length are complete without padding
            k = exact.get(at - power)
            if k is not None and best[k] < least:
                least, i = best[k], k
        best[j] = least + (cost[j - 1] if j < n else 0.0)
        back[j] = i
        value[j] = best[j] + at
        while queue and value[queue[-1]] >= value[j]:
            queue.pop()
        queue.append(j)
        exact[at] = j
    chosen, j = [], n
    while j:
        chosen.append(where[j])
        j = back[j]
    return np.array(chosen[::-1], dtype=np.int64), best[n]


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray, options: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts are allowed and what they cost; long stretches without a boundary get one in every quarter of a sequence."""
    costs = np.array([options.word_cut, options.sentence_cut, 0.0])
    kind = np.zeros(len(ids) + 1, np.uint8)
    for end in sentence_ends:
        kind[1:] |= ids == end
    kind[doc_ends] = 2
    place = np.flatnonzero(kind)
    edges = np.concatenate(([0], place))
    step = options.size // 4
    wide = np.flatnonzero(np.diff(edges) > step)
    if len(wide):
        place = np.union1d(place, np.concatenate([np.arange(edges[i] + step, edges[i + 1], step) for i in wide]))
    return place, costs[kind[place]]


def last_windows(length: int, options: Packing) -> list[int]:
    """A short last window as lengths without padding, by binary digits, if those cuts cost less than its padding."""
    digits = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    whole = 0 if len(digits) == 1 else options.size - length
    return digits if (len(digits) - 1) * options.word_cut < whole else [length]


def plan(ids: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray, options: Packing, final: bool) -> np.ndarray:
    """Ends of the block's sequences. If more blocks follow, the ids after the last of them are left for the next block."""
    place, cost = boundaries(ids, doc_ends, sentence_ends, options)
    ends, _ = cuts(place, cost, options.size)
    if not final:
        return ends[:-1] if len(ends) > 1 else ends
    before = int(ends[-2]) if len(ends) > 1 else 0
    tail = last_windows(int(ends[-1]) - before, options)
    return np.concatenate((ends[:-1], before + np.cumsum(tail)))


_WORDS: dict[tuple[str, int], Words] = {}


def tokenizer_words(path: str, remembered: int) -> Words:
    if (path, remembered) not in _WORDS:
        _WORDS[path, remembered] = Words(path, remembered)
    return _WORDS[path, remembered]


def pack(docs: DataFrame, tokenizer: str, options: Packing = Packing()) -> DataFrame:
    """Pieces of documents in sequences: one row per piece, with the place in its document and in its sequence."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer_words(tokenizer, options.remembered)
        first_id = TaskContext.get().partitionId() << LOCAL_BITS
        made = 0
        held: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, ids before, ids of the whole document, the ids left
        count = 0

        def emit(final: bool) -> pa.RecordBatch:
            nonlocal held, made, count
            stream = np.concatenate([x[3] for x in held])
            doc_ends = np.cumsum([len(x[3]) for x in held])
            ends = plan(stream, doc_ends, words.ends, options, final)
            rows: list[list] = [[] for _ in range(8)]
            d = 0
            begin = 0
            doc_begin = 0
            for end in ends.tolist():
                at = begin
                while at < end:
                    stop = min(end, int(doc_ends[d]))
                    doc_id, before, total, _ = held[d]
                    for column, x in zip(rows, (doc_id, before + at - doc_begin, stop - at, zlib.crc32(stream[at:stop].tobytes()), total, first_id + made, at - begin, end - begin), strict=True):
                        column.append(x)
                    at = stop
                    if stop == doc_ends[d]:
                        doc_begin = stop
                        d += 1
                made += 1
                begin = end
            rest = held[d:]
            if rest:
                doc_id, before, total, own = rest[0]
                gone = begin - doc_begin
                rest[0] = (doc_id, before + gone, total, own[gone:].copy())
            held, count = rest, len(stream) - begin
            return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"])

        end = np.array([options.end_id], dtype="<u4")
        for batch in slices(batches, "text", 4 << 20):
            texts = [x or b"" for x in batch.column("text").to_pylist()]
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), words.ids(texts), strict=True):
                ids = np.concatenate((found, end))
                held.append((doc_id, 0, len(ids), ids))
                count += len(ids)
                if count >= options.block:
                    yield emit(False)
        if held:
            yield emit(True)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), pieces, PIECES)
