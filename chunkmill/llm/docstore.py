"""A copy of the texts in files of bounded size that tasks read by (file, row), so later passes needn't shuffle all texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from chunkmill.llm.common import filesystem, partitions

SHARD_BYTES = 16 << 20


class ShardWriter:
    """Writes texts to files named after this attempt; add() tells where a text will lie once close() has returned."""

    def __init__(self, folder: str, shard_bytes: int = SHARD_BYTES):
        self.files, self.base = filesystem(folder)
        self.files.create_dir(self.base, recursive=True)
        self.attempt, self.number, self.limit = uuid.uuid4().hex[:16], 0, shard_bytes
        self.held: list[bytes] = []
        self.size = 0

    def add(self, text: bytes) -> tuple[str, int]:
        if self.size >= self.limit:
            self.close()
        self.held.append(text)
        self.size += len(text)
        return f"{self.attempt}-{self.number:05d}", len(self.held) - 1

    def close(self) -> None:
        if self.held:
            column = pa.table({"text": pa.array(self.held, pa.large_binary())})
            with self.files.open_output_stream(f"{self.base}/{self.attempt}-{self.number:05d}.parquet", compression=None) as out:
                pq.write_table(column, out, compression="zstd", use_dictionary=False, write_statistics=False)
            self.number += 1
        self.held, self.size = [], 0


def read_shard(folder: str, shard: str) -> pa.ChunkedArray:
    files, base = filesystem(folder)
    with files.open_input_file(f"{base}/{shard}.parquet") as source:
        return pq.read_table(source, columns=["text"], use_threads=False).column("text")


def with_texts(rows: DataFrame, folder: str, apply: Callable[[list[dict], list[bytes]], Iterator[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Deal rows by shard and give apply the rows of a batch of one shard, with their texts; it yields rows of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, column = None, None
        for batch in batches:
            wanted = batch.to_pylist()
            k = 0
            while k < len(wanted):
                first, shard = k, wanted[k]["shard"]
                while k < len(wanted) and k - first < 500 and wanted[k]["shard"] == shard:
                    k += 1
                if shard != name:
                    name, column = shard, read_shard(folder, shard)
                part = wanted[first:k]
                got = column.take(pa.array([r["row"] for r in part])).to_pylist()
                yield pa.RecordBatch.from_pylist(list(apply(part, got)), schema=schema)

    return rows.repartition(partitions(rows.sparkSession), "shard").sortWithinPartitions("shard", "row").mapInArrow(run, ddl)
