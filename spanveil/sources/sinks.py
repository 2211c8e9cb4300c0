"""Redacted texts and logs, written."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators.summary import logs
from ..workers import reach_workers
from .files import is_file, mirrored, root_of


def write_texts(redacted: DataFrame, source: str, output: str) -> None:
    """One UTF-8 file for each document that was read, in folders like the source's.

    ``output`` is a path or the URI of any store that Arrow's file systems reach (hdfs, s3, gs, file) from all executors. For large collections write
    ``redacted`` as Parquet instead; this is for people who want files.
    """
    spark = redacted.sparkSession
    reach_workers(spark)
    root, single = root_of(spark, source), is_file(spark, source)
    files = redacted.where(F.col("redacted").isNotNull()).select(mirrored(F.col("doc_id"), root, single).alias("below"), "redacted")
    target = root_of(spark, output)

    def write(rows: Iterator[Row]) -> None:
        store, top = FileSystem.from_uri(re.sub("^file:/+", "file:///", target))
        for row in rows:
            path = f"{top.rstrip('/')}/{unquote(row['below'])}"
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(f"{path}.part") as file:
                file.write(row["redacted"].encode())
            store.move(f"{path}.part", path)  # a task that runs again leaves one whole file

    files.foreachPartition(write)


def write_logs(redacted: DataFrame, path: str, with_text: bool = False) -> None:
    """JSON lines of what was masked, appended; the masked text itself only if asked for."""
    found = logs(redacted).withColumnRenamed("doc_id", "file")
    (found if with_text else found.drop("substr")).write.mode("append").json(path)
