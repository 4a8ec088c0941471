"""A log of changed files, and a Spark data source that streams it.

The log is a folder of numbered JSON files, one for each commit or merge: {repo_id, repo_path, sha, paths}. A number is given to
one writer (see Files.publish), so the numbers have no gaps, and an offset of the stream is the last number that was read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from chunkmill.plans.schema import CHANGE
from chunkmill.sources.files import Files


def _name(number: int) -> str:
    return f"{number:012d}.json"


def _numbers(names: list[str]) -> list[int]:
    return [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]


def append(spark: SparkSession, folder: str, repo_id: str, repo_path: str, sha: str | None, paths: list[str]) -> int:
    """Add a change set to the log; its number."""
    files, text = Files(spark), json.dumps({"repo_id": repo_id, "repo_path": repo_path, "sha": sha, "paths": paths})
    number = max(_numbers(files.names(folder)), default=0) + 1
    while not files.publish(f"{folder}/{_name(number)}", text):
        number += 1
    return number


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if ":" in folder else f"file://{os.path.abspath(folder)}")


class _Numbers(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.each = options["path"], int(options.get("files_per_partition", 20))

    def initialOffset(self) -> dict:
        return {"number": 0}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        files, path = _open(self.folder)
        found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return {"number": max(_numbers([f.base_name for f in found]), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Numbers(k, min(k + self.each - 1, end["number"])) for k in range(start["number"] + 1, end["number"] + 1, self.each)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, path = _open(self.folder)
        for number in range(partition.first, partition.last + 1):
            with files.open_input_stream(f"{path}/{_name(number)}") as source:
                told = json.loads(source.read())
            for changed in told["paths"]:
                yield told["repo_id"], told["repo_path"], changed, told.get("sha"), number

    def commit(self, end: dict) -> None:
        pass


class Changes(DataSource):
    """Options: path, files_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "repo_changes"

    def schema(self):
        return CHANGE

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """(repo_id, repo_path, path, sha, number) of the log, as a stream."""
    spark.dataSource.register(Changes)
    return spark.readStream.format("repo_changes").option("path", folder).load()
