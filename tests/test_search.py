import importlib.util
import random

import pytest
from pyspark.sql import functions as F

from chunkmill.operators import evaluate, inspect, savings, search, staleness, store, symbol
from chunkmill.plans import views

SF = "/root/testdata/sf0.001"


def hits(spark, rows, tokens=()):
    data = [(0, k + 1, p, a, b, code, s, float(score)) for k, (p, a, b, code, s, score) in enumerate(rows)]
    df = spark.createDataFrame(data, "query_id int, raw_rank int, path string, start_line int, end_line int, code string, symbol string, score double")
    return df.withColumn("query_tokens", F.array(*[F.lit(t) for t in tokens]).cast("array<string>"))


def paths(df):
    return [(r["path"], r["score"]) for r in df.orderBy("rank").collect()]


def test_limit(spark):
    rows = [(f"f{k}.py", 1, 2, "x", None, 1 - k / 10) for k in range(8)]
    assert len(paths(search.rank_candidates(hits(spark, rows), 3))) == 3


def test_trivial(spark):
    rows = [("pkg/__init__.py", 1, 1, "# marker", None, 0.99), ("pkg/fixtures.py", 1, 6, "a\nb\nc\nd\ne\nf", None, 0.75)]
    assert paths(search.rank_candidates(hits(spark, rows), 5)) == [("pkg/fixtures.py", 0.75)]


def test_collapse_then_limit(spark):
    """Against a plain reading of the rule, with the limit after it: hidden hits take no place."""
    r = random.Random(4)
    rows = [(r.choice(["lib/a.ts", "lib/b.ts"]), *sorted((r.randrange(1, 60), r.randrange(1, 60))), "x", None, 1 - k / 50) for k in range(30)]
    kept = []
    for path, first, last, *_ in rows:
        over = lambda a, b, first=first, last=last: min(b, last) - max(a, first) + 1
        hidden = any(p == path and over(a, b) > 0 and (over(a, b) in (b - a + 1, last - first + 1) or 2 * over(a, b) > min(b - a, last - first) + 1) for p, a, b in kept)
        kept += [] if hidden else [(path, first, last)]
    got = search.rank_candidates(hits(spark, rows), 6).orderBy("rank").collect()
    assert len(kept) > 6 and [(h["path"], h["start_line"], h["end_line"]) for h in got] == kept[:6]


def test_boost(spark):
    rows = [("tests/test_service.py", 1, 2, "x", None, 0.85), ("pkg/service.py", 1, 2, "x", "OrderService", 0.75)]
    assert paths(search.rank_candidates(hits(spark, rows, ["orderservice", "order"]), 5)) == [("pkg/service.py", 0.95), ("tests/test_service.py", 0.85)]
    assert [p for p, _ in paths(search.rank_candidates(hits(spark, rows, ["some"]), 5))][0] == "tests/test_service.py"


def test_ties_keep_raw_order(spark):
    rows = [("b.py", 1, 2, "x", None, 0.5), ("a.py", 1, 2, "x", None, 0.5)]
    assert [p for p, _ in paths(search.rank_candidates(hits(spark, rows), 5))] == ["b.py", "a.py"]


def test_paths_agree(spark):
    from chunkmill.plans import queries as Q

    a, b = Q.knn_topk(spark, SF), Q.knn_topk_arrow(spark, SF)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_queries_are_a_stated_set(spark):
    points, queries = views.chunks(spark, SF).select("id", "vector"), views.queries(spark, SF).select("query_id", "query_vector")
    a, b = search.knn(points, queries, 4), search.knn_blocks(points, queries, 4, 2).select("query_id", "id", "score", "raw_rank")
    a = a.select(*b.columns)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    with pytest.raises(Exception, match="more than 3 queries"):
        search.stated(queries, 3).collect()


def test_plans(spark):
    chunks = views.chunks(spark, SF)
    plan = search.nearest(chunks, [0.1] * 64, 5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    plan = search.knn(chunks.select("id", "vector"), views.queries(spark, SF), 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    plan = inspect.stats_by_language(chunks)._jdf.queryExecution().executedPlan().toString()
    assert "embedding:array" not in plan


def test_symbol_search(spark):
    files = [("service.py", "class OrderService:\n"), ("consumer.py", "from s import OrderService\nx\nOrderService().go()"), ("noise.py", "OrderServiceHelper = 1\norderservice = 2")]
    df = spark.createDataFrame([(p, bytearray(c, "utf-8")) for p, c in files] + [("b.bin", bytearray(b"OrderService\0"))], "path string, content binary")
    got = [(r["path"], r["start_line"]) for r in symbol.symbol_hits(df, "OrderService").orderBy("path", "start_line").collect()]
    assert got == [("consumer.py", 1), ("consumer.py", 3), ("service.py", 1)]


def test_file_stands_in_for_a_blank_path(spark):
    df = spark.createDataFrame([(1, " ", "a.py", "python"), (2, "b.py", "x", "python"), (3, None, "", "python")], "id int, path string, file string, language string")
    assert sorted(r["path"] for r in inspect.inventory(df).collect()) == ["a.py", "b.py"]


def test_tokens_are_words_of_any_script(spark):
    from chunkmill.functions import scalar

    text = "Où est_ce, Straße-42? 日本 x²"
    got = spark.createDataFrame([(text,)], "t string").select(scalar.tokens(F.col("t")).alias("t")).first()["t"]
    assert sorted(got) == scalar.query_tokens(text)


def test_candidates_carry_the_points(spark):
    points, queries = views.chunks(spark, SF), views.queries(spark, SF)
    a = search.candidates(points, queries, 4).select("query_id", "id", "score", "raw_rank")
    b = search.knn(points.select("id", "vector"), queries.drop("query_tokens"), 4).select("query_id", "id", "score", "raw_rank")
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and a.count() == 4 * queries.count()


def test_cases_from_yaml(spark, tmp_path):
    from chunkmill.sources import eval_inputs, plain_yaml

    text = """# cases
- id: one   # a comment
  query: "where is \\"x: y\\" # not one"
  k: 7
  expect_in_top_k:
    - "a/b.py"
    - 'it''s.py'
  expect_rank_above:
    above: a.py
    below: b.py
  must_pass: true
  tags: [x, "y, z"]

- id: two
  query: plain words, a url http://h/p#q
  must_pass: false   # softer
  expect_all:
  - c.py
"""
    (tmp_path / "cases.yaml").write_text(text)
    want = [
        {"id": "one", "query": 'where is "x: y" # not one', "k": 7, "expect_in_top_k": ["a/b.py", "it's.py"], "expect_rank_above": {"above": "a.py", "below": "b.py"}, "must_pass": True, "tags": ["x", "y, z"]},
        {"id": "two", "query": "plain words, a url http://h/p#q", "must_pass": False, "expect_all": ["c.py"]},
    ]
    assert plain_yaml.load(text) == want
    if importlib.util.find_spec("yaml"):
        import yaml

        assert yaml.safe_load(text) == want
    rows = {r["case_id"]: r for r in eval_inputs.load_cases(spark, str(tmp_path / "cases.yaml")).collect()}
    assert rows["one"]["tags"] == ["x", "y, z"] and rows["two"]["k"] == 5 and rows["one"]["expect_rank_above"]["below"] == "b.py"
    assert plain_yaml.load("a: 1.5\nb:\n  - - 1\n    - 2\n  - {c: d}\ne:\n") == {"a": 1.5, "b": [[1, 2], {"c": "d"}], "e": None}
    for bad in ("a: &x 1", "a: [1", "a:\n\t- 1", "a: 'x", "k: 1\n  l: 2"):
        with pytest.raises(plain_yaml.YamlError):
            plain_yaml.load(bad)


def test_windows_are_appended(spark, tmp_path):
    """Windows leave the state for files once the watermark has passed them."""
    from chunkmill.streaming import ledger

    folder = tmp_path / "in"
    folder.mkdir()
    schema = "time timestamp, returned_tokens bigint, baseline_tokens_upper bigint, saved_tokens_upper bigint"
    rows = [("2024-01-02 00:00:00", 1, 2, 1), ("2024-01-03 00:00:00", 1, 2, 1), ("2024-02-20 00:00:00", 5, 6, 1)]
    spark.createDataFrame(rows, "time string, returned_tokens bigint, baseline_tokens_upper bigint, saved_tokens_upper bigint").write.json(str(folder / "part"))
    for _ in range(2):
        stream = ledger.windowed(spark.readStream.schema(schema).json(str(folder / "part")))
        ledger.append_windows(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert [(r["queries"], r["returned_tokens"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, 2)]


def test_inventory_filter_acts_on_the_page(spark):
    df = spark.createDataFrame([(1, "a.py", "python"), (2, "a.py", "python"), (3, "a.py", "python"), (4, "b.ts", "typescript"), (5, "b.ts", "typescript"), (6, " ", "python")], "id int, path string, language string")
    total, rows = inspect.page(inspect.inventory(df), 0, 100, "python")
    assert (total, [tuple(r) for r in rows.collect()]) == (2, [("a.py", "python", 3)])


def test_ledger(spark):
    import datetime as D

    now = D.datetime(2024, 5, 20, tzinfo=D.UTC)
    line = '{{"ts": "{}", "returned_tokens": {}, "baseline_tokens_upper": {}, "saved_tokens_upper": {}}}'
    lines = [line.format((now - D.timedelta(days=1)).isoformat(), 10, 100, 90), line.format((now - D.timedelta(days=20)).isoformat(), 20, 80, 60), "not json", "  ", '{"returned_tokens": 4}']
    events = savings.parse_ledger(spark.createDataFrame([(x,) for x in lines], "value string"))
    r = savings.rollup(events, 7, F.lit(now).cast("timestamp")).first()
    assert (r["all_queries"], r["corrupt_lines"], r["all_returned_tokens"], r["all_baseline_tokens"], r["all_saved_tokens"], r["all_pct"]) == (2, 2, 30, 180, 150, 83)
    assert (r["window_queries"], r["window_returned_tokens"], r["window_saved_tokens"], r["window_pct"]) == (1, 10, 90, 90)


def test_unreadable_time_counts_in_all_time_only(spark):
    events = savings.parse_ledger(spark.createDataFrame([('{"ts": "yesterday", "returned_tokens": 4}',)], "value string"))
    r = savings.rollup(events, 7, F.lit("2024-01-01").cast("timestamp")).first()
    assert (r["all_queries"], r["window_queries"], r["corrupt_lines"], r["first_at"]) == (1, 0, 0, None)


def test_upsert(spark):
    ddl = "id string, repo_id string, path string, code string"
    old = spark.createDataFrame([("1", "r", "a", "x"), ("2", "r", "b", "x"), ("3", "r", "c", "x")], ddl)
    new = spark.createDataFrame([("2", "r", "b", "new", 1), ("2", "r", "b", "newest", 2)], ddl + ", batch int")
    gone = spark.createDataFrame([("r", "b"), ("r", "c")], "repo_id string, path string")
    assert sorted((r["id"], r["code"]) for r in store.incremental(old, new, gone).collect()) == [("1", "x"), ("2", "newest")]
    assert store.upsert(old, new.limit(0)).count() == 3


def test_changes(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "path string, hash string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "4")], "path string, hash string")
    assert sorted(tuple(r) for r in staleness.changes(a, b).collect()) == [("w", "added"), ("y", "modified"), ("z", "deleted")]
    row = spark.range(1).select(staleness.is_stale(F.lit(True), F.lit(None), F.lit("a")).alias("n"), staleness.is_stale(F.lit(True), F.lit("b"), F.lit("a")).alias("y")).first()
    assert (row["n"], row["y"]) == (False, True)


def test_eval_metrics(spark):
    fields = "case_id bigint, k int, expect_in_top_k array<string>, forbid_in_top_k array<string>, expect_all array<string>, expect_rank_above struct<above: string, below: string>, must_pass boolean, tags array<string>"
    cases = spark.createDataFrame([
        (1, 2, ["b.py"], ["*/__init__.py"], ["a.py", "zz.py"], ("a.py", "b.py"), True, ["t", "u"]),
        (2, 5, None, ["*"], None, ("b.py", "nope"), True, ["t"]),
        (3, 5, ["q.py"], None, None, None, False, ["u"]),
    ], fields)
    results = spark.createDataFrame([(1, 1, "a.py"), (1, 2, "a.py"), (1, 3, "b.py"), (1, 4, "p/__init__.py"), (2, 1, "b.py")], "case_id bigint, rank int, path string")
    m = {r["case_id"]: r for r in evaluate.case_metrics(cases, results).collect()}
    assert (m[1]["recall_at_k"], m[1]["mrr"], m[1]["noise_at_k"], m[1]["definition_rank_pass"], m[1]["symbol_completeness"]) == (1.0, 0.5, 0.0, True, 0.5)
    assert m[1]["failed_checks"] == ["expect_all"] and not m[1]["passed"]
    assert (m[2]["recall_at_k"], m[2]["noise_at_k"], m[2]["definition_rank_pass"]) == (None, 1.0, False)
    assert (m[3]["recall_at_k"], m[3]["mrr"]) == (0.0, 0.0)
    metrics = evaluate.case_metrics(cases, results)
    total = evaluate.aggregate(metrics).first()
    assert (total["case_count"], total["passed_count"], total["recall_at_k"]) == (3, 0, 0.5)
    assert {r["tag"]: r["case_count"] for r in evaluate.by_tag(metrics).collect()} == {"t": 2, "u": 2}
    expected = spark.createDataFrame([(1,)], "case_id bigint")
    assert [r["case_id"] for r in evaluate.unexpected_failures(metrics, expected).collect()] == [2]
    better = spark.range(1).select(F.lit(0.6).alias("recall_at_k"), F.lit(0.1).alias("mrr"), F.lit(0.0).alias("noise_at_k"), F.lit(None).alias("definition_rank_pass_rate"), F.lit(0.5).alias("symbol_completeness"))
    assert sorted(r["metric"] for r in evaluate.metric_regressions(evaluate.aggregate(metrics), better).collect()) == ["noise_at_k", "recall_at_k"]


@pytest.mark.parametrize("n", [0, 51])
def test_limits_are_checked(spark, tmp_path, n):
    from chunkmill.service import Service
    from chunkmill.sources.embed import HashEmbedder

    with pytest.raises(ValueError):
        Service(spark, str(tmp_path), HashEmbedder()).search("r", "q", n)
