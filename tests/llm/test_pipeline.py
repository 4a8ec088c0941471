import random
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from chunkmill.llm import queries as llm
from chunkmill.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_decontaminate", "op4_warc", "op8_minhash", "op9_suffix_dedup", "mixing_targets"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(llm.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=repr)
    df = llm.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == want


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in llm.queries() if n.startswith("op")] == [f"op{k}" for k in range(1, 14)]
    assert set(llm.queries()) | {"pipeline"} <= set(entry.queries())


def test_pipeline(spark):
    """Stage by stage: what goes, goes for its reason; what stays keeps its columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontaminate", "mixing", "tokens"]
    stage = dict(corpus_pipeline.STAGES)
    one = stage["language"](spark, docs, SF)
    assert one.columns == docs.columns and docs.count() - one.count() <= 4
    two = stage["near_duplicates"](spark, docs, SF)
    kept = llm.queries()["op8_minhash"](spark, SF).where("kept")
    assert two.columns == docs.columns and {r["doc_id"] for r in two.collect()} == {r["doc_id"] for r in kept.collect()}
    three = stage["decontaminate"](spark, docs, SF)
    clean = llm.queries()["op3_decontaminate"](spark, SF).where("not contaminated")
    assert three.columns == docs.columns and {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in clean.collect()}
    last = corpus_pipeline.run(spark, SF)
    rows = sorted(last.collect(), key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)


def test_pipeline_of_odd_rows(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and extra columns through all stages."""
    r = random.Random(12)
    text = lambda n: " ".join("".join(r.choice(["the", "and", "ing", "tion", "er"]) for _ in range(r.randrange(1, 4))) for _ in range(n))
    rows = [(k, text(40), "en", ["s", "t", None][k % 3], 40, "x", None) for k in range(60)]
    rows += [rows[0], rows[0], (0, text(40), "en", "s", 40, "x", None), (70, None, None, None, None, None, None), (71, "", "en", "s", 0, "", None), (72, text(30_000), "en", "t", 1, "x", None), (None, text(40), None, "s", 4, "x", 1), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, score int")
    ids, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns, name
        ids.append(sorted(Counter(x["doc_id"] for x in docs.collect()).items(), key=str))
    assert (70, 1) not in ids[0] and (71, 1) not in ids[0] and (72, 1) in ids[0] and (0, 4) in ids[0] and (None, 1) in ids[0]
    assert (0, 2) in ids[1] and (None, 1) in ids[1]
    last = corpus_pipeline.tokens(spark, docs, SF)
    found = sorted(((x["start"], x["n_tokens"]) for x in last.collect()))
    assert len(found) == docs.count() and [a for a, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))]


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
