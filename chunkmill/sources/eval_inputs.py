"""Evaluation inputs and the baseline file: cases from JSON or YAML, baselines as JSON."""

from __future__ import annotations

import importlib.util
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkmill.plans.schema import CASE, EVAL_K
from chunkmill.sources import plain_yaml


def load(path: str):
    with open(path, encoding="utf-8") as source:
        text = source.read()
    if path.endswith((".yaml", ".yml")):
        return _yaml(text)
    return json.loads(text)


def _yaml(text: str):
    """By PyYAML where it is installed, else by the reader for lists of records."""
    if importlib.util.find_spec("yaml"):
        import yaml

        return yaml.safe_load(text)
    return plain_yaml.load(text)


def cases(spark: SparkSession, items: list[dict]) -> DataFrame:
    """Case records with defaults; absent expectations stay null."""
    rows = []
    for item in items:
        above = item.get("expect_rank_above")
        rows.append((
            item["id"], item["query"], int(item.get("k", EVAL_K)), item.get("mode", "semantic"), bool(item.get("must_pass", False)), item.get("expect_in_top_k"), item.get("forbid_in_top_k"),
            item.get("expect_all"), (above["above"], above["below"]) if above else None, item.get("tags", []),
        ))
    return spark.createDataFrame(rows, CASE).withColumn("case_id", F.col("id"))


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    data = load(path)
    return cases(spark, data["cases"] if isinstance(data, dict) else data)


def baseline_frames(spark: SparkSession, baseline: dict) -> dict[str, DataFrame]:
    """The arguments that evaluation takes from a baseline: its aggregate, its cases and the failures it expects."""
    from chunkmill.plans.schema import METRICS

    total = baseline.get("aggregate") or {}
    one = spark.range(1).select(*[F.lit(total.get(m)).cast("double").alias(m) for m in METRICS])
    return {
        "baseline": one,
        "baseline_cases": spark.createDataFrame([(c["id"], bool(c.get("passed"))) for c in baseline.get("cases", []) if c.get("id")], "case_id string, passed boolean"),
        "expected_failures": spark.createDataFrame([(x,) for x in baseline.get("expected_fail", [])], "case_id string"),
    }


def write_baseline(path: str, report: dict) -> dict:
    """The baseline that a report makes: aggregate, cases, and the must_pass cases that fail now. Moved into place whole."""
    found = [r.asDict(recursive=True) for r in report["cases"].orderBy("case_id").collect()]
    metrics = ("recall_at_k", "mrr", "noise_at_k", "definition_rank_pass", "symbol_completeness")
    out = {
        "expected_fail": [c["case_id"] for c in found if c["must_pass"] and not c["passed"]],
        "aggregate": report["aggregate"].first().asDict(),
        "cases": [{"id": c["case_id"], "must_pass": c["must_pass"], "passed": c["passed"], "failed_checks": c["failed_checks"], "metrics": {m: c[m] for m in metrics}} for c in found],
    }
    with open(path + ".tmp", "w", encoding="utf-8") as target:
        json.dump(out, target, indent=2)
    os.replace(path + ".tmp", path)
    return out
