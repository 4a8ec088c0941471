"""The ledger of searches: JSON lines, a small file for each append, which compact() folds into a merged table.

A line is known by its file and place. Files that have been folded are deleted afterwards; where one is still there, after a
failure, its lines are read once all the same.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkmill.operators.savings import parse_ledger
from chunkmill.operators.store import Table
from chunkmill.plans.schema import LEDGER_LINE
from chunkmill.sources.files import Files

PART = "lines"


def append(spark: SparkSession, folder: str, event: dict) -> bool:
    """Best effort: a failure never fails the search."""
    try:
        line = json.dumps({"event_id": uuid.uuid4().hex, "ts": datetime.now(UTC).isoformat(), **event})
        Files(spark).write(f"{folder}/{uuid.uuid4().hex}.jsonl", line + "\n")
        return True
    except Exception:
        return False


def _table(spark: SparkSession, folder: str) -> Table:
    return Table(spark, folder, "folded", LEDGER_LINE, by=None)


def _names(spark: SparkSession, folder: str) -> list[str]:
    return [n for n in Files(spark).names(folder) if n.endswith(".jsonl")]


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """(id, value) of the lines of all files."""
    whole = spark.read.text(f"{folder}/*.jsonl", wholetext=True)
    rows = whole.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("k", "value"))
    return rows.where(F.trim("value") != "").select(F.concat("file", F.lit(":"), "k").alias("id"), "value")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the folded lines and of all files; none where the folder is missing."""
    rows = _table(spark, folder).read(PART)
    if _names(spark, folder):
        new = _lines(spark, folder)
        rows = rows.unionByName(new.join(rows.select("id"), "id", "left_anti"))
    return parse_ledger(rows.select("value"))


def compact(spark: SparkSession, folder: str) -> int:
    """Fold the files that are there into the table; their number. Appends may go on meanwhile."""
    names = _names(spark, folder)
    if names:
        files = spark.createDataFrame([(n,) for n in names], "file string")
        lines = _lines(spark, folder).withColumn("file", F.regexp_extract("id", "^(.*):", 1)).join(files, "file", "left_semi")
        _table(spark, folder).merge(PART, lines.select("id", "value"))
        for name in names:
            Files(spark).delete(f"{folder}/{name}")
    return len(names)
