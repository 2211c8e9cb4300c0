"""Python workers and this package, and the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def reach_workers(spark: SparkSession | None = None) -> None:
    """Workers find this package by the driver's path; a cluster without that path takes it from --py-files."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{known}" if known else ROOT


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one if the driver is the only machine, else an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spanveil-")
        context.setCheckpointDir(named)
    return named.rstrip("/")
