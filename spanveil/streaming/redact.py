"""Redaction of document streams. It is stateless: no watermark, no state store, each micro-batch is one narrow plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..config import Bundle
from ..plans.pipeline import redact
from ..schema import Options
from ..workers import shared_folder


def redact_stream(stream: DataFrame, bundle: Bundle | None = None, options: Options = Options(), text: str = "text", key: str | None = None) -> DataFrame:
    """A streaming frame with ``redacted`` and ``logs``; the patterns of the moment stay with it."""
    return redact(stream, bundle, options, text, key)


def read_files(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", most_files: int = 1000) -> DataFrame:
    """A stream of the files of a folder. A file stream watches folders, so a single file is picked out of its folder by name."""
    reader = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", most_files)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).load(where.getParent().toString())
    return reader.load(path)


def write_files(frame: DataFrame, path: str, checkpoint: str, kind: str = "parquet", available_only: bool = True) -> StreamingQuery:
    """Exactly-once files; with ``available_only`` the query ends when what is there has been read."""
    writer = frame.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_only else writer).start()


def redact_available(spark: SparkSession, path: str, bundle: Bundle | None = None) -> DataFrame:
    """All documents of a folder or file through a stream: doc_id and redacted text."""
    work = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = read_files(spark, path, spark.read.parquet(path).schema)
    out = redact_stream(stream.select("doc_id", "text"), bundle).select("doc_id", "redacted")
    write_files(out, f"{work}/out", f"{work}/state").awaitTermination()
    return spark.read.schema("doc_id long, redacted string").parquet(f"{work}/out")
