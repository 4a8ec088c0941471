"""Is an index behind its source? By commit, or by comparing manifests of file hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_stale(registered: Column, indexed_sha: Column, head_sha: Column) -> Column:
    return F.coalesce(registered & (indexed_sha != head_sha), F.lit(False))


def manifest(files: DataFrame, content: str = "content") -> DataFrame:
    return files.select("path", F.sha1(F.col(content).cast("binary")).alias("hash"))


def changes(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """path and change (added, deleted, modified) between two manifests (path, hash)."""
    old, new = indexed.select("path", F.col("hash").alias("old")), current.select("path", F.col("hash").alias("new"))
    both = old.join(new, "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")
