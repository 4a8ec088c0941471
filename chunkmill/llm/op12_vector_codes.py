"""Vector codes: integer codebooks for eight parts of each vector, learned over all vectors in exact integer arithmetic.

Each component x becomes floor(4096 x). A task gets the codebooks (16 entries a part, so as many numbers as 16 vectors) and
computes the squared distances of its Arrow batches by norm expansion, |x|^2 - 2 x.c + |c|^2, with int64 matrix products; the
first least one counts. Sums and counts of an entry's parts are added up in the task, then by a grouped shuffle, so a
round moves at most 16 rows a component and task, whatever the number of vectors. All sums are of integers: neither the
order of rows nor the layout changes a result. Nothing but codebooks and their sums reaches the driver.

Defined results: vectors that are null or hold null or non-finite components go; vectors of unequal lengths, or lengths that
8 doesn't divide, are filled up with zeros at their end to the next multiple of 8 of the longest (as columns are; the largest
must fit a task); of rows with one vec_id those with the lesser vector start a codebook first, and a null vec_id comes
last; with fewer than 16 vectors codebooks have fewer entries; components beyond 2^61 count as 2^61, and an error beyond the
range of a long is its largest value; where squares could pass int64, distances are taken with unbounded integers. Equal rows
give equal rows; an empty table gives none; columns other than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkmill.llm.common import arrow_limits, materialize, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Largest component and error, and rows of a batch.
MOST, MOST_ERROR, BATCH = 1 << 61, (1 << 63) - 1, 2000


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    x = vector.cast("array<double>")
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of floor(4096 x), filled up with zeros to width."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    flat = np.clip(flat, -float(MOST), float(MOST)).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows x and books (parts, entries, width of a part): index of the nearest entry, the first of equals, and squared distance, by row and part."""
    parts, _, width = books.shape
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)))
    if 4 * most * most * width >= 1 << 62:
        x, books = x.astype(object), books.astype(object)
    found, error = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), x.dtype)
    for p in range(parts):
        own, book = x[:, p * width : (p + 1) * width], books[p]
        distance = (own * own).sum(1)[:, None] - 2 * (own @ book.T) + (book * book).sum(1)[None, :]
        found[:, p] = distance.argmin(1)
        error[:, p] = distance[np.arange(len(x)), found[:, p]]
    return found, error


def first_books(vectors: DataFrame) -> np.ndarray:
    """Codebooks that start as the parts of the vectors with the smallest vec_ids."""
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    if width is None:
        return np.zeros((PARTS, 0, 1), np.int64)
    width = max(1, -(-width // PARTS)) * PARTS
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()
    x = integers(pa.array([[float(v) for v in r[0]] for r in rows], pa.list_(pa.float64())), width)
    return x.reshape(len(x), PARTS, width // PARTS).transpose(1, 0, 2).copy()


def learn(vectors: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after rounds of assigning every part and replacing each entry that is used by the floor of its parts' mean."""
    for _ in range(rounds):
        sent = books

        def run(batches: Iterator[pa.RecordBatch], books: np.ndarray = sent) -> Iterator[pa.RecordBatch]:
            parts, entries, width = books.shape
            sums, counts = np.zeros(books.shape, object), np.zeros((parts, entries), np.int64)
            for batch in batches:
                x = integers(batch.column(0), parts * width)
                found, _ = nearest(x, books)
                small = len(x) * int(np.abs(x).max(initial=0)) < 1 << 62
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width].astype(np.int64 if small else object)
                    hot = (found[:, p, None] == np.arange(entries)).astype(own.dtype)
                    sums[p] += hot.T @ own
                    counts[p] += np.bincount(found[:, p], minlength=entries)
            p, e = np.nonzero(counts)
            at = np.tile(np.arange(width), len(p))
            p, e = np.repeat(p, width), np.repeat(e, width)
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(at, pa.int32()), pa.array([str(v) for v in sums[p, e, at]]), pa.array(counts[p, e])], names=["part", "entry", "at", "total", "n"])

        made = vectors.select("embedding").mapInArrow(run, "part int, entry int, at int, total string, n long")
        added = made.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        books = books.copy()
        for r in added.collect():  # as many rows as the codebooks have numbers
            books[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error."""
    fields = dict(vectors.select("vec_id", "label").dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, error = nearest(integers(batch.column("embedding"), books.shape[0] * books.shape[2]), books)
            codes = [bytes(row).hex() for row in found.astype(np.uint8)]
            errors = [min(sum(row), MOST_ERROR) for row in error.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(run, f"vec_id {fields['vec_id']}, label {fields['label']}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector. A hot label's errors are added up before they are shuffled."""
    spark = vectors.sparkSession
    arrow_limits(spark, BATCH)
    vectors = vectors.where(usable(F.col("embedding"))).select("vec_id", "embedding", "label")
    books = learn(vectors, first_books(vectors), rounds)
    coded = materialize(encode(vectors, books), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    of_label = coded.groupBy(F.col("label").alias("_label")).agg(F.least(total, F.lit(MOST_ERROR).cast("decimal(38,0)")).cast("long").alias("label_error"))
    rows = coded.join(of_label, F.col("label").eqNullSafe(F.col("_label")))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Rounds as chained tables. For vectors of one length that the number of parts divides."""
    out = rf"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS x FROM v, range({PARTS}) r(part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}))"""
    near = "SELECT vec_id, part, x, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{k} USING (part)"
    for k in range(ROUNDS + 1):
        out += f""",
a{k} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, CAST(min(d) AS BIGINT) AS d, arg_min(entry, (d, entry)) AS entry FROM ({near.format(k=k)}) GROUP BY vec_id, part)"""
        if k < ROUNDS:
            out += f""",
m{k} AS (SELECT part, entry, list(CAST(floor_mean AS BIGINT) ORDER BY i) AS c FROM (
  SELECT part, entry, i, (CAST(sum(y) AS BIGINT) - ((CAST(sum(y) AS BIGINT) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean FROM (SELECT part, entry, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY part, entry, i) GROUP BY part, entry),
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} m USING (part, entry))"""
    return (
        out
        + f""",
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM e JOIN v USING (vec_id), h
"""
    )


SQL = _sql()
