"""Incremental indexing of a stream of changed files: each batch is one plan over all of its repositories, merged once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chunkmill.sources.repo_files import ignored, read_file


def contents(changes: DataFrame) -> DataFrame:
    """(repo_id, path, content) of the changed files (repo_id, repo_path, path) that are there and are to be indexed; tasks read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, root, path in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "repo_path", "path")), strict=True):
                found = None if ignored(path) else read_file(root, path)
                if found is not None and found[3] is None:
                    rows.append((repo, path, found[2]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.string()), (1, pa.string()), (2, pa.binary()))], names=["repo_id", "path", "content"])

    return changes.select("repo_id", "repo_path", "path").distinct().mapInArrow(run, "repo_id string, path string, content binary")


def on_changes(changes: DataFrame, merge: Callable[[DataFrame, int], object], checkpoint: str) -> StreamingQuery:
    """Start a query over a stream of changes that gives each batch, and its number, to merge. A number that comes again, after a failure, brings the same rows."""
    return changes.writeStream.foreachBatch(lambda rows, number: merge(rows, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_commit(changes: DataFrame) -> DataFrame:
    """(repo_id, sha) of the last change set of each repository."""
    return changes.groupBy("repo_id").agg(F.max_by("sha", "number").alias("sha"))
