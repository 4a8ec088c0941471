"""Cosine similarity: a JVM expression, and an Arrow path for wide vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyarrow.dataset import ParquetFragmentScanOptions, dataset
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; norms that are known aren't computed again."""
    return _dot(a, b) / ((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))


def require_dim(vector: Column, dim: int) -> Column:
    """The vector; an error where its length isn't dim."""
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(vector).cast("string"))))


#: Bytes of points, as doubles, that a task holds while the queries pass by, queries read at once, and scores that it holds at once.
POINT_BYTES, QUERY_ROWS, SCORES = 64 << 20, 256, 2 << 20


def _rows(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest of each row; of equal ones the first columns."""
    if scores.shape[1] <= k:
        return tuple(x.reshape(-1) for x in np.indices(scores.shape))
    least = np.partition(scores, -k, axis=1)[:, -k, None]
    above, level = scores > least, scores == least
    return np.nonzero(above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True))))


def top_k_arrow(points: DataFrame, queries: DataFrame, k: int, folder: str) -> DataFrame:
    """(query_id, id, score): the best k of every lot of points by matrix product; the rows that remain are ranked by the caller.

    Queries (query_id, query_vector), of any number, are written to folder, which tasks must see. Points (id, vector) are scanned once and not
    shuffled: a task gathers POINT_BYTES of them and then reads the queries past them, so it holds a lot of points, QUERY_ROWS queries and
    SCORES scores (or those of one query), however many points and queries there are.
    """
    queries.select("query_id", "query_vector").where("query_vector is not null").write.option("parquet.block.size", str(4 << 20)).parquet(folder)
    kinds = dict(queries.dtypes) | dict(points.dtypes)

    def asked() -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        options = ParquetFragmentScanOptions(use_buffered_stream=True, pre_buffer=False)  # a file isn't held whole
        yield from dataset(path, filesystem=files, format="parquet", exclude_invalid_files=False).to_batches(batch_size=QUERY_ROWS, batch_readahead=1, fragment_readahead=1, use_threads=False, fragment_scan_options=options)

    def lot(held: list[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([i for i, _ in held])
        order = pc.sort_indices(ids)
        ids, place = ids.take(order), np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        vectors, at = np.empty((len(ids), held[0][1].shape[1])), 0
        while held:
            _, x = held.pop(0)
            vectors[place[at : at + len(x)]] = x
            at += len(x)
        rows = max(1, SCORES // len(ids))
        for batch in asked():
            for some in (batch.slice(n, rows) for n in range(0, batch.num_rows, rows)):
                scores = _rows(some.column("query_vector")) @ vectors.T
                np.round(scores, 6, out=scores)
                i, j = _best(scores, k)
                yield pa.RecordBatch.from_arrays([some.column("query_id").take(pa.array(i)), ids.take(pa.array(j)), pa.array(scores[i, j])], names=["query_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0), _rows(batch.column(1))))
                if sum(x.nbytes for _, x in held) >= POINT_BYTES:
                    yield from lot(held)  # which empties it
        if held:
            yield from lot(held)

    return points.select("id", "vector").where("vector is not null").mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
