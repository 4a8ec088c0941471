"""An inverted-file index of vectors with product codes, for approximate and for exact nearest neighbours of many queries.

The index is a Parquet table partitioned by cell: id, code (a byte for each subspace), miss (how far the code is off) and the
vector itself. A search reads codes alone; full vectors are read where a pair has survived, to score it. Cells and codes are
fitted on a bounded sample; what is fitted decides how much is looked at, and for exact() never what is found.

Codes of a cell and the queries that probe it meet in blocks of bounded size, whatever a cell holds, and only survivors leave.
Vectors that are null, zero or hold components that are null, non-finite or beyond MOST aren't indexed; ids are unique.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkmill.functions.quantizer import Quantizer, unit
from chunkmill.functions.vector import cosine
from chunkmill.sources.files import Files

#: Rows of the sample, of it those asked to set the number of probes, and the recall that they must reach.
SAMPLE, ASKED, RECALL, NEIGHBOURS = 8192, 256, 0.95, 15
#: Codes and queries of a block; survivors of an approximate search for each wanted neighbour.
CODES_BLOCK, QUERIES_BLOCK, KEPT = 8192, 1024, 4
#: What rounding, of a score to six digits too, may add to a bound.
SLACK = 3e-6
#: Largest component, whose square is a finite number.
MOST = 1e150


def _unit_vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def _usable(points: DataFrame) -> DataFrame:
    x = F.col("vector").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(MOST))) & F.exists(x, lambda v: v != 0)
    return points.where(F.coalesce(fine, F.lit(False)))


@dataclass
class VectorIndex:
    spark: SparkSession
    folder: str
    quantizer: Quantizer
    #: Of each cell: rows, and the least cosine of one of them to the centroid.
    sizes: np.ndarray
    least: np.ndarray
    probes: int

    # Building

    @classmethod
    def build(cls, points: DataFrame, folder: str, dims: int = 2, cells: int | None = None) -> VectorIndex | None:
        """Write the index of points (id, vector; all of one length) to folder; None where there are none. dims: components for each byte of a code."""
        spark = points.sparkSession
        points = _usable(points.select("id", "vector"))
        rows = points.count()
        if not rows:
            return None
        drawn = points.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
        x = _unit_vectors(drawn.column("vector"))
        quantizer = Quantizer.fit(x, cells or round(rows**0.5), -(-x.shape[1] // dims))
        kinds = dict(points.dtypes)

        def place(batches):
            for batch in batches:
                if batch.num_rows:
                    x = _unit_vectors(batch.column("vector"))
                    score = x @ quantizer.centroids.T
                    cell = score.argmax(1)
                    codes, miss = quantizer.encode(x, cell)
                    near = score[np.arange(len(x)), cell]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(miss), pa.array(near)], names=["id", "vector", "cell", "code", "miss", "near"])

        placed = points.mapInArrow(place, f"id {kinds['id']}, vector {kinds['vector']}, cell int, code binary, miss double, near double")
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{folder}/cells")
        index = cls(spark, folder, quantizer, np.zeros(len(quantizer.centroids), np.int64), np.ones(len(quantizer.centroids)), _probes(x, quantizer))
        for r in index.table().groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near")).collect():  # a row of each cell
            index.sizes[r["cell"]], index.least[r["cell"]] = r["n"], r["near"]
        index._save()
        return index

    def _save(self) -> None:
        told = {"centroids": self.quantizer.centroids.tolist(), "books": [b.tolist() for b in self.quantizer.books], "cuts": self.quantizer.cuts, "sizes": self.sizes.tolist(), "least": self.least.tolist(), "probes": self.probes}
        Files(self.spark).write(f"{self.folder}/index.json", json.dumps(told))

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorIndex:
        told = json.loads(Files(spark).read(f"{folder}/index.json"))
        quantizer = Quantizer(np.array(told["centroids"]), [np.array(b) for b in told["books"]], told["cuts"])
        return cls(spark, folder, quantizer, np.array(told["sizes"]), np.array(told["least"]), told["probes"])

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/cells")

    # Searching

    def one(self, vector: list[float], k: int, probes: int | None = None) -> DataFrame:
        """The k nearest points of one vector in the cells nearest to it: a scan of those partitions alone."""
        q = unit(np.array([vector], np.float64))
        cells = np.argsort(-(q @ self.quantizer.centroids.T)[0], kind="stable")[: probes or self.probes]
        literal = F.array(*[F.lit(float(x)) for x in vector])
        found = self.table().where(F.col("cell").isin([int(c) for c in cells])).select("id", F.round(cosine(F.col("vector"), literal), 6).alias("score"))
        return found.orderBy(F.col("score").desc(), "id").limit(k)

    def approximate(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, raw_rank): of the codes in the cells nearest to a query, KEPT x k with the best estimates are scored in full."""
        return self._scored(self._estimated(queries, k, probes), queries, k)

    def exact(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, raw_rank): the true k nearest. A pair is scored unless its code proves that k others are nearer."""
        return self._scored(self._survivors(queries, k), queries, k)

    def _estimated(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        n, kept = probes or self.probes, KEPT * k
        asks = self._asks(queries, lambda near, _: np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1) < n)

        def best(estimate, miss, floor):
            return _largest(estimate, kept)

        order = W.partitionBy("query_id").orderBy(F.col("value").desc(), "id")
        found = self._meet(asks, best)
        return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= kept).select("query_id", "id", "cell")

    def _survivors(self, queries: DataFrame, k: int) -> DataFrame:
        """Pairs that may be among the k nearest. First the codes of the cells that an approximate search probes, and of further ones until they hold
        k rows, give each query a score that k points reach at least; cells and codes that can't reach it are passed over."""
        sizes, radius, probes = self.sizes, np.arccos(np.clip(self.least, -1, 1)), self.probes

        def first(near, _):
            order = np.argsort(-near, axis=1, kind="stable")
            enough = np.cumsum(sizes[order], axis=1) - sizes[order] < k
            enough[:, :probes] = True
            out = np.zeros(near.shape, bool)
            np.put_along_axis(out, order, enough, 1)
            return out

        def sure(estimate, miss, floor):
            return _largest(estimate - miss - SLACK, k)

        lows = self._meet(self._asks(queries, first), sure).groupBy("query_id").agg(F.sort_array(F.collect_list("value"), False).alias("lows"))
        floors = lows.select("query_id", F.get("lows", F.lit(k - 1)).alias("floor"))

        def within(near, floor):
            best = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - radius - 1e-9))
            return (best + SLACK >= floor[:, None]) & (sizes > 0)

        def able(estimate, miss, floor):
            i, j = np.nonzero(estimate + miss + SLACK >= floor[:, None])
            return i, j, estimate[i, j]

        asked = queries.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        return self._meet(self._asks(asked, within), able).select("query_id", "id", "cell")

    def _asks(self, queries: DataFrame, choose: Callable) -> DataFrame:
        """(query_id, query_vector, floor, cell) for the cells that choose(products with the centroids, floors) marks."""
        quantizer, kinds = self.quantizer, dict(queries.dtypes)
        rows = queries.select("query_id", "query_vector", "floor" if "floor" in kinds else F.lit(-2.0).alias("floor"))
        rows = _usable(rows.withColumn("vector", F.col("query_vector"))).drop("vector")

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    near = _unit_vectors(batch.column("query_vector")) @ quantizer.centroids.T
                    i, cell = np.nonzero(choose(near, batch.column("floor").to_numpy()))
                    for k in range(0, len(i), QUERIES_BLOCK):
                        own = batch.take(pa.array(i[k : k + QUERIES_BLOCK]))
                        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell[k : k + QUERIES_BLOCK], pa.int32())], names=["query_id", "query_vector", "floor", "cell"])

        return rows.mapInArrow(run, f"query_id {kinds['query_id']}, query_vector {kinds['query_vector']}, floor double, cell int")

    def _meet(self, asks: DataFrame, choose: Callable) -> DataFrame:
        """(query_id, id, cell, value) of what choose(estimates, misses, floors) picks where the codes of a cell meet the queries that probe it."""
        quantizer = self.quantizer
        parts = np.maximum(1, -(-self.sizes // CODES_BLOCK)).astype(int).tolist()
        of_cell = F.element_at(F.array(*[F.lit(p) for p in parts]), F.col("cell") + 1)
        counts = asks.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES_BLOCK).cast("int").alias("nq"))
        codes = self.table().select("id", "code", "miss", "cell").join(counts, "cell")
        codes = codes.select("id", "code", "miss", "cell", F.pmod(F.xxhash64("id"), of_cell).cast("int").alias("d"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"))
        asks = asks.join(counts, "cell").select("query_id", "query_vector", "floor", "cell", F.explode(F.sequence(F.lit(0), of_cell - 1)).alias("d"), F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int").alias("q"))
        kinds = dict(codes.dtypes) | dict(asks.dtypes)
        names = ["query_id", "id", "cell", "value"]

        def block(left: pa.Table, right: pa.Table) -> pa.Table:
            schema = pa.schema([(right if n == "query_id" else left).schema.field(n) for n in names[:2]] + [("cell", pa.int32()), ("value", pa.float64())])
            if not left.num_rows or not right.num_rows:
                return schema.empty_table()
            cell, out = left.column("cell")[0].as_py(), []
            stood = quantizer.decode(np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(left.num_rows, -1), cell)
            ids, miss = left.column("id"), left.column("miss").to_numpy()
            for k in range(0, right.num_rows, 256):
                some = right.slice(k, 256)
                i, j, value = choose(_unit_vectors(some.column("query_vector")) @ stood.T, miss, some.column("floor").to_numpy())
                out.append(pa.table([some.column("query_id").take(pa.array(i)), ids.take(pa.array(j)), pa.array(np.full(len(i), cell), pa.int32()), pa.array(value, pa.float64())], schema=schema))
            return pa.concat_tables(out)

        key = ["cell", "d", "q"]
        return codes.groupBy(*key).cogroup(asks.groupBy(*key)).applyInArrow(block, f"query_id {kinds['query_id']}, id {kinds['id']}, cell int, value double")

    def _scored(self, pairs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """Cosines of the full vectors, ranked; ties by id."""
        full = self.table().select("cell", "id", "vector")
        rows = pairs.join(full, ["cell", "id"]).join(queries.select("query_id", "query_vector"), "query_id")
        scored = rows.select("query_id", "id", F.round(cosine(F.col("vector"), F.col("query_vector")), 6).alias("score"))
        order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
        return scored.withColumn("raw_rank", F.row_number().over(order)).where(F.col("raw_rank") <= k)


def _largest(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the n largest of each row."""
    few = np.argpartition(-values, min(n, values.shape[1]) - 1, axis=1)[:, :n]
    return np.repeat(np.arange(len(values)), few.shape[1]), few.reshape(-1), np.take_along_axis(values, few, 1).reshape(-1)


def _probes(x: np.ndarray, quantizer: Quantizer) -> int:
    """The fewest nearest cells that hold RECALL of the nearest neighbours which rows of the sample have in it."""
    asked = x[:: max(1, len(x) // ASKED)]
    own = (x @ quantizer.centroids.T).argmax(1)
    rank = np.argsort(np.argsort(-(asked @ quantizer.centroids.T), axis=1, kind="stable"), axis=1)
    few = min(NEIGHBOURS, len(x))
    nearest = np.argpartition(-(asked @ x.T), few - 1, axis=1)[:, :few]
    needed = np.sort(np.take_along_axis(rank[:, own], nearest, 1).reshape(-1))
    return int(needed[int(np.ceil(RECALL * len(needed))) - 1]) + 1
