"""The chunk, query and case views over the test tables; the same definitions are given in SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkmill.functions.scalar import newlines, tokens
from chunkmill.functions.session import python_path
from chunkmill.operators import search

#: Queries and evaluation cases are the rows whose id is divisible by this.
EVERY = 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    python_path(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a vector, as chunks of synthetic files."""
    d, e = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings")
    rows = d.join(e, F.col("doc_id") == F.col("vec_id"))
    start = ((F.col("doc_id") * 7) % 60 + 1).cast("int")
    number = F.col("doc_id") % 40
    path = F.when(number == 0, F.concat("lang", F.lit("/pkg/__init__.py"))).otherwise(F.concat("lang", F.lit("/f"), number.cast("string"), F.lit(".txt")))
    word = F.regexp_extract("text", r"[A-Za-z0-9_]+", 0)
    symbol = F.when((F.col("doc_id") % 3 == 0) & (word != ""), word)
    return rows.select(F.col("doc_id").alias("id"), F.col("source").alias("repo_id"), F.col("lang").alias("language"), F.col("text").alias("code"), F.col("embedding").alias("vector"), path.alias("path"), start.alias("start_line"), (start + newlines(F.col("text"))).alias("end_line"), symbol.alias("symbol"), "label")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: every chunk whose id is divisible by EVERY, with its vector and the words of its whole text."""
    q = chunks(spark, sf_dir).where(F.col("id") % EVERY == 0)
    return q.select((F.col("id") / EVERY).cast("bigint").alias("query_id"), F.col("vector").alias("query_vector"), tokens(F.col("code")).alias("query_tokens"))


CHUNKS_SQL = r"""
chunks AS (
  SELECT doc_id AS id, source AS repo_id, lang AS language, text AS code, embedding AS vector,
         CASE WHEN doc_id % 40 = 0 THEN lang || '/pkg/__init__.py' ELSE lang || '/f' || CAST(doc_id % 40 AS VARCHAR) || '.txt' END AS path,
         CAST((doc_id * 7) % 60 + 1 AS INTEGER) AS start_line,
         CAST((doc_id * 7) % 60 + 1 + (length(text) - length(replace(text, chr(10), ''))) AS INTEGER) AS end_line,
         CASE WHEN doc_id % 3 = 0 THEN nullif(regexp_extract(text, '[A-Za-z0-9_]+'), '') END AS symbol, label
  FROM documents JOIN embeddings ON vec_id = doc_id)"""
QUERIES_SQL = rf"""
queries AS (
  SELECT id // {EVERY} AS query_id, vector AS query_vector, list_filter(list_distinct(regexp_split_to_array(lower(code), '[^\p{{L}}\p{{N}}_]+')), lambda t: t <> '') AS query_tokens
  FROM chunks WHERE id % {EVERY} = 0)"""


def case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest chunks of each case: case_id, rank, path."""
    c = chunks(spark, sf_dir)
    found = search.candidates(c.select("id", "path", "vector"), queries(spark, sf_dir).drop("query_tokens"), 10)
    return found.select(F.col("query_id").alias("case_id"), F.col("raw_rank").alias("rank"), "path")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases' expectations: files that hold a chunk of the query's label."""
    c = chunks(spark, sf_dir)
    q = c.where(F.col("id") % EVERY == 0).select((F.col("id") / EVERY).cast("bigint").alias("case_id"), F.col("label"))
    paths = c.select("path", "label").distinct().groupBy("label").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    expected = q.join(paths, "label").select("case_id", "paths")
    number = F.col("case_id")
    return expected.select(
        "case_id", F.lit(5).alias("k"), F.when(number % 5 != 4, F.filter("paths", lambda p: ~p.endswith("__init__.py"))).alias("expect_in_top_k"),
        F.when(number % 2 == 0, F.array(F.lit("*/__init__.py"), F.lit("fr/f?.txt"))).alias("forbid_in_top_k"), F.when(number % 3 == 0, F.slice("paths", 1, 3)).alias("expect_all"),
        F.when(number % 4 == 0, F.struct(F.element_at("paths", 1).alias("above"), F.element_at("paths", 2).alias("below"))).alias("expect_rank_above"),
        (number % 2 == 0).alias("must_pass"), F.array(F.lit("all"), F.concat(F.lit("mod"), (number % 3).cast("string"))).alias("tags"),
    )


CASES_SQL = rf"""
case_query AS (SELECT id // {EVERY} AS case_id, vector AS case_vector, label FROM chunks WHERE id % {EVERY} = 0),
results AS (
  SELECT * FROM (SELECT case_id, path, row_number() OVER (PARTITION BY case_id ORDER BY round(list_cosine_similarity(vector::DOUBLE[], case_vector::DOUBLE[]), 6) DESC, id) AS rank
  FROM chunks, case_query) WHERE rank <= 10),
expected AS (SELECT case_id, list(path ORDER BY path) AS paths FROM (SELECT DISTINCT path, case_id FROM chunks JOIN case_query USING (label)) GROUP BY case_id),
cases AS (
  SELECT case_id, 5 AS k, CASE WHEN case_id % 5 <> 4 THEN list_filter(paths, lambda p: NOT ends_with(p, '__init__.py')) END AS expect_in_top_k,
         CASE WHEN case_id % 2 = 0 THEN ['.*/__init__\.py', 'fr/f.\.txt'] END AS forbid, CASE WHEN case_id % 3 = 0 THEN paths[1:3] END AS expect_all,
         CASE WHEN case_id % 4 = 0 THEN paths[1] END AS above, CASE WHEN case_id % 4 = 0 THEN paths[2] END AS below,
         case_id % 2 = 0 AS must_pass, ['all', 'mod' || CAST(case_id % 3 AS VARCHAR)] AS tags
  FROM expected),
files AS (SELECT case_id, path, row_number() OVER (PARTITION BY case_id ORDER BY r) AS rank FROM (SELECT case_id, path, min(rank) AS r FROM results GROUP BY 1, 2)),
m AS (
  SELECT c.*,
    (SELECT min(rank) FROM files f WHERE f.case_id = c.case_id AND rank <= k AND list_contains(expect_in_top_k, path)) AS first_rank,
    (SELECT avg(CASE WHEN regexp_full_match(path, forbid[1], 'i') OR regexp_full_match(path, forbid[2], 'i') THEN 1.0 ELSE 0.0 END) FROM files f WHERE f.case_id = c.case_id AND rank <= k) AS noise,
    (SELECT min(rank) FROM files f WHERE f.case_id = c.case_id AND path = above) AS above_rank,
    (SELECT min(rank) FROM files f WHERE f.case_id = c.case_id AND path = below) AS below_rank,
    (SELECT count(*) FROM files f WHERE f.case_id = c.case_id AND list_contains(expect_all, path)) AS present
  FROM cases c),
metrics AS (
  SELECT case_id, must_pass, tags,
    CASE WHEN len(expect_in_top_k) > 0 THEN CASE WHEN first_rank IS NULL THEN 0.0 ELSE 1.0 END END::DOUBLE AS recall_at_k,
    CASE WHEN len(expect_in_top_k) > 0 THEN coalesce(round(1.0::DOUBLE / first_rank, 6), 0.0) END::DOUBLE AS mrr,
    CASE WHEN forbid IS NOT NULL THEN coalesce(round(noise, 6), 0.0) END::DOUBLE AS noise_at_k,
    CASE WHEN above IS NOT NULL THEN coalesce(above_rank < below_rank, false) END AS definition_rank_pass,
    CASE WHEN len(expect_all) > 0 THEN round(present::DOUBLE / len(expect_all), 6) END::DOUBLE AS symbol_completeness
  FROM m),
verdict AS (
  SELECT *, NOT (coalesce(recall_at_k < 1, false) OR coalesce(noise_at_k > 0, false) OR coalesce(NOT definition_rank_pass, false) OR coalesce(abs(symbol_completeness - 1) > 1e-9, false)) AS passed FROM metrics)"""
