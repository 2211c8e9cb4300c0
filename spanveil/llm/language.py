"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text becomes counts of the byte 2- and 3-grams of its lowered letters, hashed to ``dims`` dimensions; log(1 + count) times the inverse document frequency,
scaled to length 1. Document frequencies cover all labelled documents of the training part. Each language has up to ``centroids`` centroids from spherical k-means over a
bounded sample of its labelled documents (``sample`` a language in expectation, fewer where more than ``total`` would come together, chosen by a hash of the id).
If there are more than ``languages`` label values, those with the most documents are learnt. A text takes the language of
the nearest centroid by cosine; its score is that cosine. A text farther from every centroid than ``slack`` times what training documents
reach at least (their ``quantile``) is marked as rejected. A text of few distinct n-grams can't come near a centroid of thousands, so the
bound shrinks with the root of their number below ``evidence``.

The training part is everything but one document in five, by a checksum of the id. Prediction sees the text alone, row by row, without a
shuffle; the model (dims x centroids numbers) travels with the task.

Defined cases: a text that is null or without a letter is ``und`` with score 0 and is rejected; with nothing to learn from every text is; null labels and null ids are not learnt from;
a null id is not held out; of centroids that are equally near, the first one's language by name counts; repeated rows are learnt from and judged each by itself; a very long text is
counted whole, in pieces; ``identify`` reads no other column and ``accepted`` keeps every column, whatever its name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

UNKNOWN = "und"
#: ASCII bytes other than letters part words; bytes of other characters stay.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass(frozen=True)
class Identification:
    dims: int = 4096
    centroids: int = 4
    sample: int = 600
    #: Bounds of what is learnt from: label values, and documents of the sample over all of them.
    languages: int = 256
    total: int = 12_000
    quantile: float = 0.01
    slack: float = 0.5
    evidence: int = 64
    rounds: int = 10


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: float
    evidence: int

    def bound(self, distinct: np.ndarray) -> np.ndarray:
        return self.least * np.sqrt(np.minimum(distinct / self.evidence, 1.0))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(text: str, dims: int) -> np.ndarray:
    """Hashed n-gram counts of a whole text, in pieces of bounded memory that overlap by an n-gram."""
    data = b" " + b" ".join(text.lower().encode().translate(LETTERS).split()) + b" "
    shift = np.uint32(32 - (dims.bit_length() - 1))
    total = np.zeros(dims, np.int64)
    step = 1 << 20
    for at in range(0, len(data), step):
        x = np.frombuffer(data, np.uint8, min(len(data) - at, step + 2), at).astype(np.uint32)
        two = x[:-1] * np.uint32(257) + x[1:]
        three = two[:-1] * np.uint32(257) + x[2:] + np.uint32(1 << 25)
        for grams in (two[:step], three[:step]):
            total += np.bincount((grams * np.uint32(2654435761)) >> shift, minlength=dims)
    return total


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def vectors(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(rows).astype(np.float32) * idf)


def cluster(points: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means, begun with the points farthest from those before."""
    chosen = [points.mean(axis=0)]
    while len(chosen) < min(k, len(points)):
        near = (points @ unit(np.array(chosen)).T).max(axis=1)
        chosen.append(points[int(near.argmin())])
    centres = unit(np.array(chosen))
    for _ in range(rounds):
        own = (points @ centres.T).argmax(axis=1)
        centres = unit(np.array([points[own == i].mean(axis=0) for i in range(len(centres)) if (own == i).any()]))
    return centres


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; null of null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def document_frequencies(texts: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    """In how many texts each dimension occurs, summed on the executors; one number a dimension comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(dims, np.int64), 0
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                if has_letter(text):
                    found += counts(text, dims) > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims, dtype=np.int32)), pa.array(np.concatenate(([n], found)))], ["dim", "df"])

    summed = map_arrow(texts.select("text"), run, "dim int, df long").groupBy("dim").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(dims + 1, np.int64)
    for row in summed:
        out[row["dim"] + 1] = row["df"]
    return out[1:], int(out[0])


def sample(learnable: DataFrame, options: Identification) -> tuple[list[str], np.ndarray]:
    """Languages and counts of the bounded sample, in the order of its ids."""
    counted = learnable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(options.languages)
    sizes = {r["lang"]: r["n"] for r in counted.collect()}
    if not sizes:
        return [], np.zeros((0, options.dims), np.int64)
    each = min(options.sample, options.total / len(sizes))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, each / n))]), F.col("lang"))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    dims = options.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, langs, places, numbers = [], [], [], []
            for doc_id, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True):
                if has_letter(text):
                    found = counts(text, dims)
                    held = np.flatnonzero(found)
                    ids.append(doc_id)
                    langs.append(lang)
                    places.append(held.astype(np.int16).tobytes())
                    numbers.append(found[held].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(places, pa.binary()), pa.array(numbers, pa.binary())], ["doc_id", "lang", "places", "numbers"])

    rows = map_arrow(learnable.where(drawn < share), run, "doc_id long, lang string, places binary, numbers binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], bytes(r["places"]), bytes(r["numbers"])))
    out = np.zeros((len(rows), dims), np.int32)
    for i, row in enumerate(rows):
        out[i, np.frombuffer(row["places"], np.int16)] = np.frombuffer(row["numbers"], np.int32)
    return [r["lang"] for r in rows], out


def learn(docs: DataFrame, options: Identification = Identification()) -> Model:
    learnable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    learnable = learnable.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 0))
    frequencies, n = document_frequencies(learnable, options.dims)
    idf = np.log((1 + n) / (1 + frequencies)).astype(np.float32) + np.float32(1)
    langs, rows = sample(learnable, options)
    names: list[str] = []
    centres = np.zeros((0, options.dims), np.float32)
    points = vectors(rows, idf) if langs else centres
    for lang in sorted(set(langs)):
        own = cluster(points[[i for i, x in enumerate(langs) if x == lang]], options.centroids, options.rounds)
        names += [lang] * len(own)
        centres = np.concatenate((centres, own))
    least = float(np.quantile((points @ centres.T).max(axis=1), options.quantile)) * options.slack if langs else 2.0
    return Model(tuple(names), centres, idf, least, options.evidence)


def judged(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    at = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
    langs, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    for first in range(0, len(at), 512):
        part = at[first : first + 512]
        grams = np.array([counts(texts[i], len(model.idf)) for i in part])
        near = vectors(grams, model.idf) @ model.centroids.T
        best = near.argmax(axis=1)
        score[part] = np.clip(np.round(near.max(axis=1).astype(np.float64), 6), 0, 1)
        rejected[part] = score[part] < model.bound((grams > 0).sum(axis=1))
        for i, b in zip(part, best.tolist(), strict=True):
            langs[i] = model.languages[b]
    return langs, score, rejected


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            langs, score, rejected = judged(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs), pa.array(score), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    doc_id = F.col("doc_id").cast("long")
    held = F.coalesce(remainder(doc_id) == 0, F.lit(False))
    return map_arrow(docs.select(doc_id.alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")), run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not rejected, as they are."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names[at]):
            yield batch.filter(pa.array(~judged(batch.column(at).to_pylist(), model)[2]))

    return map_arrow(docs, run, docs.schema)
