"""Exact identifier search over current file contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkmill.functions.scalar import is_binary, language_for, word_pattern


def symbol_search(files: DataFrame, identifier: str, text: str = "text") -> DataFrame:
    """Every line with the identifier as a whole word, case-sensitive, literal: the file's other columns, line_no and line.

    Whole texts are tested before they are split; there is no shuffle and no limit, since completeness is the point.
    """
    pattern = word_pattern(identifier)
    found = files.where(F.col(text).contains(identifier))
    lines = found.select(*[c for c in files.columns if c != text], F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("line_no", F.col("line_no") + 1).where(F.col("line").rlike(pattern))


def symbol_hits(files: DataFrame, identifier: str) -> DataFrame:
    """symbol_search() over (path, content) files as search hits with score 1 and one-line ranges; binary files are left out."""
    readable = files.where("content is not null").where(~is_binary(F.col("content"))).select("path", F.decode("content", "UTF-8").alias("text"))
    found = symbol_search(readable, identifier)
    line = F.col("line_no").cast("int")
    return found.select("path", language_for(F.col("path")).alias("language"), line.alias("start_line"), line.alias("end_line"), F.regexp_replace("line", "\r$", "").alias("code"), F.lit(identifier).alias("symbol"), F.lit(1.0).alias("score"))


def completeness(found: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """Share of the expected paths that were found anywhere in the results."""
    seen = found.select(key).distinct().withColumn("_seen", F.lit(1))
    rows = expected.select(key).distinct().join(seen, key, "left")
    return rows.agg(F.count("*").alias("expected"), F.count("_seen").alias("present"), F.round(F.count("_seen") / F.count("*"), 6).alias("symbol_completeness"))
