"""Vector search and what follows it: over-fetch, definition boost, stable ranking, trivial-file filter, overlap collapse, limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkmill.functions import scalar as S
from chunkmill.functions.session import workspace
from chunkmill.functions.vector import cosine, norm, top_k_arrow
from chunkmill.plans.schema import OVERFETCH, TRIVIAL_LINES


#: Queries that one search may broadcast.
MOST_QUERIES = 1000


def stated(queries: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """queries, checked when the plan runs: an error where there are more than may be broadcast."""
    count = F.count(F.lit(1)).over(W.partitionBy())
    fits = F.when(F.col("_count") <= most, F.lit(True)).otherwise(F.raise_error(F.lit(f"more than {most} queries: use knn_blocks")).cast("boolean"))
    return queries.withColumn("_count", count).where(fits).drop("_count")


def knn_blocks(points: DataFrame, queries: DataFrame, k: int, block: int = MOST_QUERIES) -> DataFrame:
    """knn() for any number of queries: broadcast up to a block of them, and read past the points from shared files beyond that. One scan of the points."""
    return knn(points, queries, k) if queries.count() <= block else knn_arrow(points, queries, k)


def knn(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest points of each query with raw_rank; queries is a small stated set and is broadcast.

    Ranks are cut within each partition before the shuffle (WindowGroupLimit), so only k rows per query and partition move.
    """
    left = points.withColumn("_norm", norm(F.col("vector")))
    right = stated(queries).withColumn("_query_norm", norm(F.col("query_vector")))
    score = cosine(F.col("vector"), F.col("query_vector"), F.col("_norm"), F.col("_query_norm"))
    scored = left.join(F.broadcast(right)).withColumn("score", F.round(score, 6)).drop("vector", "query_vector", "_norm", "_query_norm")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("raw_rank", F.row_number().over(order)).where(F.col("raw_rank") <= k)


def candidates(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest points of each query with all their columns: ranked by id and vector alone, and then looked up."""
    top = knn_arrow(points, queries, k)
    return points.drop("vector").join(top, "id").join(queries.drop("query_vector"), "query_id")


def knn_arrow(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The same ranking (query_id, id, score, raw_rank) by matrix products, for a query table of any size: one scan of the points, past which tasks read the queries."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    found = top_k_arrow(points.select("id", "vector"), queries, k, workspace(points.sparkSession, "queries"))
    return found.withColumn("raw_rank", F.row_number().over(order)).where(F.col("raw_rank") <= k)


def nearest(points: DataFrame, vector: list[float], k: int) -> DataFrame:
    """The k nearest points of one vector: TakeOrderedAndProject, no join."""
    literal = F.array(*[F.lit(float(x)) for x in vector])
    scored = points.withColumn("score", F.round(cosine(F.col("vector"), literal), 6)).drop("vector")
    top = scored.orderBy(F.col("score").desc(), "id").limit(k)
    return top.withColumn("query_id", F.lit(0)).withColumn("raw_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")))


def boost(hits: DataFrame, tokens: Column) -> DataFrame:
    """Add the definition boost and rank again; ties keep the raw order."""
    hits = hits.withColumn("score", F.round(S.boosted(F.col("score"), F.col("symbol"), tokens), 6))
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "raw_rank")))


def drop_trivial(hits: DataFrame) -> DataFrame:
    """Drop package-marker files none of whose hits has more than a few non-blank lines."""
    most = F.max(S.nonblank_lines(F.col("code"))).over(W.partitionBy("query_id", "path"))
    return hits.withColumn("most_lines", most).where(~(S.is_trivial(F.col("path")) & (F.col("most_lines") <= TRIVIAL_LINES))).drop("most_lines")


def collapse(hits: DataFrame, key: tuple[str, ...] = ("query_id", "path"), order: str = "rank") -> DataFrame:
    """Keep a hit unless it overlaps one kept before it in the same file; one ordered fold per query and file.

    A file's hits are at most a query's candidates, so the collected list is bounded by the over-fetch.
    """
    rest = [c for c in hits.columns if c not in key]
    item = F.struct(F.col(order).alias("_order"), *rest)
    ordered = hits.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.slice("items", 1, 0)
    step = lambda kept, x: F.when(F.exists(kept, lambda k: S.collapses(k, x)), kept).otherwise(F.concat(kept, F.array(x)))
    return ordered.select(*key, F.explode(F.aggregate("items", none, step)).alias("item")).select(*key, *[F.col("item")[c].alias(c) for c in rest])


def limit(hits: DataFrame, n: int) -> DataFrame:
    """The first n of each query, numbered again."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= n)


def semantic_search(points: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """The whole search for any number of queries (query_id, query_vector, query_tokens)."""
    return rank_candidates(candidates(points, queries, max(n, n * OVERFETCH)), n)


def rank_candidates(candidates: DataFrame, n: int) -> DataFrame:
    return limit(collapse(drop_trivial(boost(candidates, F.col("query_tokens")).drop("query_tokens"))), n)
