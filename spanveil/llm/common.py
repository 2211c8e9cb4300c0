"""What the operators of this subpackage share: tables, the shared folder, bounded batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..workers import reach_workers, shared_folder

#: Most rows and bytes of an Arrow batch; both hold for a session's batches in Spark's own settings.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20
#: A word of the mixing and near-duplicate contracts: anything between these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


#: Hadoop's local file system starts chmod processes for every part file and once more for its checksum file; these tables do without the latter.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Rows of a part file, of tables whose rows are known to be few numbers each.
PART_ROWS = 200_000


def settle(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here and a lost executor costs nothing before it.

    rows: about how many there are, if that is known; then the last stage has a task for each ``PART_ROWS`` of them, at most as many as before.
    The table goes when the driver's JVM ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spanveil-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(-(-rows // PART_ROWS) or 1)).write.options(**PLAIN_FILES).parquet(path)
    system, where = _file_system(spark, path)
    system.deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    back._settled_at = path
    return back


def discard(df: DataFrame | None) -> None:
    """Remove a settled table that nothing reads any more."""
    path = getattr(df, "_settled_at", None)
    if path:
        system, where = _file_system(df.sparkSession, path)
        system.delete(where, True)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow over small batches: rows here are whole texts, and a worker and its executor each hold a batch or two.

    A worker gives the memory of a task back at its end; an executor may keep many workers, and tasks go round among them.
    """
    spark = df.sparkSession
    reach_workers(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if int(spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")) not in range(1, most + 1):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Freed memory back to the system, where its allocators can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = 8 << 20, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``rows`` rows and, but for single longer values, ``budget`` bytes of ``column``."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first = held = 0
        for at, length in enumerate(lengths):
            if at > first and (held + length > budget or at - first >= rows):
                yield batch.slice(first, at - first)
                first, held = at, 0
            held += length
        if first < len(lengths):
            yield batch.slice(first)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], budget: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in order, cut between groups of equal keys (numbers without nulls) into parts of about ``budget`` bytes: a part, where its groups begin, and where they end."""
    held: list[pa.RecordBatch] = []
    size, enough = 0, budget

    def part(last: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        nonlocal held, size, enough
        whole = pa.concat_batches(held)
        columns = [whole.column(k).to_numpy() for k in keys]
        changed = np.zeros(max(0, whole.num_rows - 1), bool)
        for x in columns:
            changed |= x[1:] != x[:-1]
        begins = np.concatenate(([0], np.flatnonzero(changed) + 1))
        end = whole.num_rows if last else int(begins[-1])
        rest = whole.slice(end)
        held, size = ([rest] if rest.num_rows else []), rest.nbytes
        enough = max(budget, 2 * size)  # a group larger than the budget is not looked through again and again
        if end:
            begins = begins[begins < end]
            yield whole.slice(0, end), begins, np.append(begins[1:], end)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
            if size >= enough:
                yield from part(False)
    if held:
        yield from part(True)


def rows_of_bytes(column: pa.Array) -> np.ndarray:
    """A matrix of the bytes of values of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def parted(texts: Sequence[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of texts whose blanks are all spaces, in order, and how many each text has."""
    whole = b" ".join(texts)
    letter = np.zeros(len(whole) + 2, bool)
    np.not_equal(np.frombuffer(whole, np.uint8), 32, out=letter[1:-1])
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    begin = edges[::2]
    offsets = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(edges[1::2] - begin, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(whole.translate(None, b" "))])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return words, np.diff(np.searchsorted(begin, ends), prepend=0)


def distinct(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, and the place of each word among them."""
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def listed(words: pa.Array) -> list[bytes]:
    """Words without spaces as a list: they are split in one go, which is faster than one by one."""
    if not len(words):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(whole, b" ")[0].as_py().split(b" ")


def strung(words: np.ndarray, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of words in order, and where each word's end; flat, size: the numbers of the distinct words, one word after the other, and how many each has."""
    begin = np.cumsum(size) - size
    own = size.take(words)
    ends = np.cumsum(own)
    at = np.repeat(begin.take(words) - ends + own, own)
    at += np.arange(len(at))
    return flat.take(at), ends


def text_ends(word_ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """0 and the place where each text ends, from those of its words and how many words it has."""
    return np.append(0, word_ends)[np.append(0, np.cumsum(counts))]
