"""Masking files from the command line, by spark-submit or ``python -m spanveil.cli``."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark import StorageLevel
from pyspark.sql import SparkSession

from .config import load_patterns
from .operators import summary
from .plans.pipeline import redact
from .schema import MaskStyle, Options
from .sources.files import read_documents
from .sources.sinks import write_logs, write_texts

log = logging.getLogger("spanveil")


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="spanveil", description="Mask entities in collections of contracts.")
    add = parser.add_argument
    add("--input", required=True, help="a file or folder")
    add("--output", default="redacted", help="folder for masked texts and the log")
    add("--recursive", action="store_true", help="folders below the input, too")
    add("--mask-style", choices=[m.value for m in MaskStyle], default=MaskStyle.TAG.value)
    add("--keep-length", action="store_true", help="masks as long as what they cover")
    add("--min-score", type=float, default=0.5)
    add("--workers", type=int, default=1, help="threads of a local run; a submitted one takes the cluster's")
    add("--include", nargs="*", choices=["SUBJECT"], default=["SUBJECT"], help="optional detectors; none without a value")
    add("--dry-run", action="store_true", help="write nothing, only report")
    add("--log-level", choices=["INFO", "DEBUG"], default="INFO")
    add("--disable-office", action="store_true", help="text files only")
    add("--patterns", help="YAML or JSON file of patterns")
    add("--log-text", action="store_true", help="masked text in the log, too")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = arguments().parse_args(argv)
    logging.basicConfig(level=args.log_level, format="%(asctime)s %(levelname)s %(message)s")
    own = SparkSession.getActiveSession() if spark is None else spark
    if own is None:
        builder = SparkSession.builder.appName("spanveil")
        own = (builder if SparkSession.builder._options.get("spark.master") else builder.master(f"local[{max(1, args.workers)}]")).getOrCreate()
    options = Options(MaskStyle(args.mask_style), args.keep_length, args.min_score, "SUBJECT" in (args.include or []))
    documents = read_documents(own, args.input, args.recursive, not args.disable_office)
    done = redact(documents, load_patterns(args.patterns), options, key="doc_id").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        totals = summary.totals(summary.per_document(done)).first().asDict()
        if not totals["files"]:
            log.warning("no files in %s", args.input)
            return totals | {"by_label": {}}
        if not args.dry_run:
            write_texts(done, args.input, args.output)
            write_logs(done, f"{args.output}/redaction_log", args.log_text)
        labels = {r["label"]: r["n"] for r in summary.by_label(done).collect()}  # one row a label
    finally:
        done.unpersist()
    log.info("files %d, read %d, characters masked %d", totals["files"], totals["ok"], totals["chars_masked"])
    log.info("masked by label: %s", json.dumps(labels, ensure_ascii=False, sort_keys=True))
    return totals | {"by_label": labels}


if __name__ == "__main__":
    main()
