"""Token savings: per query, and the ledger's all-time and trailing-window rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkmill.functions.scalar import saved_percent, token_estimate, tokens_of
from chunkmill.plans.schema import LEDGER


def per_query(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Per query_id: tokens of the hits against those of their whole files (path, n_chars), each file counted once; absent files are missing."""
    returned = hits.groupBy("query_id").agg(F.sum(token_estimate(F.col("code"))).alias("returned_tokens"))
    wanted = hits.where(F.trim("path") != "").select("query_id", "path").distinct()
    sizes = files.select("path", tokens_of(F.col("n_chars")).alias("tokens"))
    found = wanted.join(sizes, "path", "left").groupBy("query_id").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("baseline_tokens_upper"), F.count("tokens").alias("files_counted"), F.count_if(F.col("tokens").isNull()).alias("files_missing"))
    rows = returned.join(found, "query_id", "left").fillna(0)
    saved = F.greatest(F.lit(0).cast("bigint"), F.col("baseline_tokens_upper") - F.col("returned_tokens"))
    rows = rows.withColumn("saved_tokens_upper", saved)
    return rows.withColumn("pct_upper", saved_percent(F.col("saved_tokens_upper"), F.col("baseline_tokens_upper")))


def parse_ledger(lines: DataFrame) -> DataFrame:
    """Lines (value) to events: the ledger's columns, corrupt (no JSON object, or no ts) and time (null where ts can't be read). Blank lines go."""
    event = F.from_json("value", LEDGER)
    rows = lines.where(F.trim("value") != "").select(event.alias("e"))
    return rows.select("e.*", (F.col("e").isNull() | F.col("e.ts").isNull()).alias("corrupt"), F.try_to_timestamp("e.ts").alias("time"))


def _sums(inside: Column, prefix: str) -> list[Column]:
    total = lambda c: F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)).cast("bigint")
    return [F.count_if(inside).alias(f"{prefix}_queries"), total("returned_tokens").alias(f"{prefix}_returned_tokens"), total("baseline_tokens_upper").alias(f"{prefix}_baseline_tokens"), total("saved_tokens_upper").alias(f"{prefix}_saved_tokens")]


def rollup(events: DataFrame, days: int, as_of: Column) -> DataFrame:
    """One row: all-time and last-days sums in one pass. Events whose ts can't be read count in the former alone."""
    good = ~F.col("corrupt")
    inside = good & F.coalesce(F.col("time") >= as_of - F.make_dt_interval(F.lit(days)), F.lit(False))
    one = events.agg(*_sums(good, "all"), *_sums(inside, "window"), F.count_if("corrupt").alias("corrupt_lines"), F.min(F.when(good, F.col("time"))).alias("first_at"), F.max(F.when(good, F.col("time"))).alias("last_at"))
    for p in ("all", "window"):
        one = one.withColumn(f"{p}_pct", saved_percent(F.col(f"{p}_saved_tokens"), F.col(f"{p}_baseline_tokens")))
    return one
