import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from chunkmill.plans import queries as core

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["semantic_search", "overlap_collapse", "savings_per_query", "ledger_rollup", "eval_case_metrics", "staleness_report", "incremental_upsert"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "events", "benchmark", "supplier", "part"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(core.oracle_sql()[name])
    names = [d[0] for d in found.description]
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(tidy(v) for v in r) for r in found.fetchall()), key=repr)
    df = core.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(tidy(r[n]) for n in names) for r in df.collect()), key=repr) == want


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def names_in(folder):
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=folder, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def copy(to, *without):
    shutil.copytree(f"{ROOT}/chunkmill", to / "chunkmill", ignore=shutil.ignore_patterns("__pycache__", *without))
    shutil.copy(f"{ROOT}/__spark_entry__.py", to)
    if os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", to)


def corpus_names(names):
    return [n for n in names if n == "pipeline" or n.startswith("op") and n[2].isdigit()]


def test_without_the_pipeline_operators(tmp_path):
    """The rest imports and keeps its queries when the subpackage and the pipeline are gone."""
    copy(tmp_path, "llm")
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    names = names_in(tmp_path)
    assert "semantic_search" in names and not corpus_names(names)


@pytest.mark.skipif(not (os.path.exists(f"{ROOT}/corpus_pipeline.py") and os.path.isdir(f"{ROOT}/chunkmill/llm")), reason="the corpus operators aren't here")
def test_each_part_may_be_absent_or_broken(tmp_path):
    """Without the pipeline's module the operators stay; where one of them can't be imported the other queries do."""
    copy(tmp_path / "a")
    (tmp_path / "a" / "corpus_pipeline.py").unlink()
    found = corpus_names(names_in(tmp_path / "a"))
    assert len(found) == 13 and "pipeline" not in found
    copy(tmp_path / "b")
    (tmp_path / "b" / "chunkmill" / "llm" / "op8_minhash.py").write_text("import a_module_that_is_not_installed\n")
    names = names_in(tmp_path / "b")
    assert "semantic_search" in names and not corpus_names(names)
