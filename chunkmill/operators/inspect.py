"""Index introspection: statistics, language arrays, file inventories and repository lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _path(chunks: DataFrame) -> F.Column:
    """The chunk's path, or its file where it has no path; null where both are blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in ("path", "file") if c in chunks.columns])


def stats_by_language(chunks: DataFrame) -> DataFrame:
    """files and chunks per language; a missing language is "unknown"."""
    language = F.coalesce("language", F.lit("unknown"))
    return chunks.select(language.alias("language"), _path(chunks).alias("path")).groupBy("language").agg(F.countDistinct("path").alias("files"), F.count("*").alias("chunks"))


def stats_total(chunks: DataFrame) -> DataFrame:
    return chunks.select(_path(chunks).alias("path")).agg(F.count("*").alias("chunk_count"), F.countDistinct("path").alias("file_count"))


def statistics(chunks: DataFrame) -> DataFrame:
    """Files and chunks of each language and, with a null language and total true, of all: one pass by grouping sets."""
    rows = chunks.select(F.coalesce("language", F.lit("unknown")).alias("language"), _path(chunks).alias("path"))
    sets = rows.groupingSets([[F.col("language")], []], F.col("language"))
    return sets.agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("chunks"), (F.grouping("language") == 1).alias("total"))


def repositories(chunks: DataFrame) -> DataFrame:
    """Registry rows derived from the chunks: counts and the language array of each repository."""
    per = chunks.select("repo_id", F.coalesce("language", F.lit("unknown")).alias("language"), _path(chunks).alias("path")).groupBy("repo_id", "language").agg(F.countDistinct("path").alias("files"), F.count("*").alias("chunks"))
    files = chunks.select("repo_id", _path(chunks).alias("path")).groupBy("repo_id").agg(F.countDistinct("path").alias("file_count"))
    arrays = per.groupBy("repo_id").agg(F.sum("chunks").alias("chunk_count"), language_list().alias("languages"))
    return arrays.join(files, "repo_id").select("repo_id", "chunk_count", "file_count", "languages")


def language_list() -> F.Column:
    """Languages by name; a repository has no more of them than the language registry."""
    return F.array_sort(F.collect_list(F.struct("language", "files", "chunks")))


def inventory(chunks: DataFrame) -> DataFrame:
    """Path, language of the first chunk, number of chunks; blank paths are left out."""
    return chunks.withColumn("path", _path(chunks)).where("path is not null").groupBy("path").agg(F.min_by("language", "id").alias("language"), F.count("*").alias("chunk_count"))


def page(files: DataFrame, offset: int, limit: int, language: str | None = None) -> tuple[int, DataFrame]:
    """Total, and the files of a page by path; a language filter acts on the page, not on the total."""
    rows = files.orderBy("path").offset(offset).limit(limit)
    return files.count(), rows if language is None else rows.where(F.col("language") == language)
