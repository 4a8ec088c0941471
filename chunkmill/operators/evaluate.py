"""Retrieval quality: rank metrics per case, aggregates, per-tag rollups and regression gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkmill.functions.scalar import matches_any
from chunkmill.plans.schema import METRICS


def file_ranks(results: DataFrame) -> DataFrame:
    """Distinct files of each case in the order of their first hit: case_id, path, file_rank. Blank paths are left out."""
    first = results.where(F.trim("path") != "").groupBy("case_id", "path").agg(F.min("rank").alias("first"))
    return first.select("case_id", "path", F.row_number().over(W.partitionBy("case_id").orderBy("first")).alias("file_rank"))


def case_metrics(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Metrics of each case; null where it has no such expectation. Files and cases meet in one join and one aggregation."""
    rows = cases.join(file_ranks(results), "case_id", "left")
    top = F.col("file_rank") <= F.col("k")
    some = lambda c: F.size(c) > 0
    rank_of = lambda c: F.min(F.when(F.col("path") == F.col(c), F.col("file_rank")))
    grouped = rows.groupBy("case_id", "must_pass", "tags", "expect_in_top_k", "forbid_in_top_k", "expect_all", "expect_rank_above").agg(
        F.min(F.when(top & F.array_contains("expect_in_top_k", F.col("path")), F.col("file_rank"))).alias("first_rank"),
        F.avg(F.when(top, matches_any(F.col("path"), F.col("forbid_in_top_k")).cast("int"))).alias("noise"),
        rank_of("expect_rank_above.above").alias("above_rank"), rank_of("expect_rank_above.below").alias("below_rank"),
        F.count_if(F.array_contains("expect_all", F.col("path"))).alias("present"),
    )
    out = grouped.select(
        "case_id", "must_pass", "tags",
        F.when(some("expect_in_top_k"), F.col("first_rank").isNotNull().cast("double")).alias("recall_at_k"),
        F.when(some("expect_in_top_k"), F.coalesce(F.bround(1 / F.col("first_rank"), 6), F.lit(0.0))).alias("mrr"),
        F.when(some("forbid_in_top_k"), F.coalesce(F.bround("noise", 6), F.lit(0.0))).alias("noise_at_k"),
        F.when(F.col("expect_rank_above").isNotNull(), F.coalesce(F.col("above_rank") < F.col("below_rank"), F.lit(False))).alias("definition_rank_pass"),
        F.when(some("expect_all"), F.bround(F.col("present") / F.size("expect_all"), 6)).alias("symbol_completeness"),
    )
    checks = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in _failures().items()]))
    return out.withColumn("failed_checks", checks).withColumn("passed", F.size("failed_checks") == 0)


def _failures() -> dict[str, Column]:
    return {
        "expect_in_top_k": F.col("recall_at_k") < 1, "forbid_in_top_k": F.col("noise_at_k") > 0,
        "expect_rank_above": ~F.col("definition_rank_pass"), "expect_all": F.abs(F.col("symbol_completeness") - 1) > 1e-9,
    }


def _averages() -> list[Column]:
    mean = lambda c: F.bround(F.avg(c), 6)
    return [
        F.count("*").alias("case_count"), F.count_if("passed").alias("passed_count"), mean(F.col("passed").cast("int")).alias("pass_rate"), mean("recall_at_k").alias("recall_at_k"), mean("mrr").alias("mrr"),
        mean("noise_at_k").alias("noise_at_k"), mean(F.col("definition_rank_pass").cast("int")).alias("definition_rank_pass_rate"), mean("symbol_completeness").alias("symbol_completeness"),
    ]


def aggregate(metrics: DataFrame) -> DataFrame:
    """One row over all cases; averages skip cases without the metric."""
    return metrics.agg(*_averages())


def by_tag(metrics: DataFrame) -> DataFrame:
    """The same per tag; a case counts once for each of its tags."""
    return metrics.withColumn("tag", F.explode("tags")).groupBy("tag").agg(*_averages())


def metric_regressions(current: DataFrame, baseline: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Metrics of two one-row aggregates that got worse by more than the tolerance; nulls are skipped."""
    long = lambda df, name: df.select(*[F.col(m).cast("double") for m in METRICS]).unpivot([], list(METRICS), "metric", name)
    both = long(current, "current").join(long(baseline, "baseline"), "metric")
    higher = F.col("metric") != "noise_at_k"
    worse = F.when(higher, F.col("current") + tolerance < F.col("baseline")).otherwise(F.col("current") - tolerance > F.col("baseline"))
    return both.where(worse).select("metric", F.bround("baseline", 6).alias("baseline"), F.bround("current", 6).alias("current"))


def flips(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """must_pass cases that passed in the baseline (case_id, passed) and fail now; cases without a baseline aren't gated."""
    before = baseline.where("passed").select("case_id")
    return metrics.where("must_pass and not passed").join(before, "case_id", "left_semi").select("case_id")


def unexpected_failures(metrics: DataFrame, expected: DataFrame) -> DataFrame:
    """Failing must_pass cases that aren't expected (case_id) to fail."""
    return metrics.where("must_pass and not passed").join(expected, "case_id", "left_anti").select("case_id", "failed_checks")
