"""Merged tables: deltas against a model, concurrent writers, sizes of what is written, compaction, clean-up, the registry's lookups."""

import os
import random
import threading
import time

import pytest
from pyspark.sql.types import StringType, StructField, StructType

from chunkmill.operators import inspect, store
from chunkmill.plans import schema as C
from chunkmill.sources.files import Files

SCHEMA = StructType([StructField(n, StringType()) for n in ("id", "path", "code")])


def new_table(spark, tmp_path):
    return store.Table(spark, str(tmp_path / "store"), "chunks", SCHEMA)


def rows_of(df):
    return sorted((r["id"], r["path"], r["code"]) for r in df.collect())


def bytes_below(folder):
    return sum(os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(folder) for n in names)


def test_versions_against_a_model(spark, tmp_path):
    """Random bases, deltas with deleted paths and equal keys, and compactions: every version reads as it was."""
    r, table, model, history = random.Random(3), new_table(spark, tmp_path), {}, {0: []}
    for k in range(12):
        new = {f"c{r.randrange(14)}": f"p{r.randrange(5)}" for _ in range(r.randrange(4))}
        rows = spark.createDataFrame([(i, p, f"v{k}") for i, p in new.items()], SCHEMA)
        if k % 5 == 0:
            version = table.replace("r", rows)
            model = {i: (p, f"v{k}") for i, p in new.items()}
        else:
            gone = {f"p{r.randrange(5)}" for _ in range(r.randrange(3))}
            frame = spark.createDataFrame([("r", p) for p in gone] * 2, "repo_id string, path string") if gone or k % 2 else None
            version = table.merge("r", rows, frame)
            model = {i: x for i, x in model.items() if x[0] not in gone} | {i: (p, f"v{k}") for i, p in new.items()}
        history[version] = sorted((i, *x) for i, x in model.items())
        if k in (3, 8):
            table.compact("r")
            assert len(table.entries("r")) == 1
            history[table.version("r")] = history[version]
    assert table.versions("r") == [v for v in history if v]
    for version, want in history.items():
        assert rows_of(table.read("r", version)) == want
    assert rows_of(table.read("r")) == rows_of(table.read_all()) == history[table.version("r")] and table.repos() == ["r"]


def test_newest_batch_of_a_delta_counts(spark, tmp_path):
    table = new_table(spark, tmp_path)
    table.merge("r", spark.createDataFrame([("a", "p", "old", 1), ("a", "p", "new", 2)], "id string, path string, code string, batch int"))
    assert rows_of(table.read("r")) == [("a", "p", "new")]


def test_a_delta_costs_what_it_holds(spark, tmp_path):
    table = new_table(spark, tmp_path)
    r = random.Random(1)
    table.replace("r", spark.createDataFrame([(f"c{k}", f"p{k % 500}", f"{r.random()}" * 20) for k in range(5000)], SCHEMA))
    base = bytes_below(tmp_path / "store")
    table.merge("r", spark.createDataFrame([("c1", "p1", "edited")], SCHEMA), spark.createDataFrame([("p1",)], "path string"))
    assert bytes_below(tmp_path / "store") - base < base / 20
    found = table.read("r")
    assert found.count() == 5000 - 10 + 1 and found.where("path = 'p1'").collect()[0]["code"] == "edited"


def test_many_deltas_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store.Table, "MOST_DELTAS", 3)
    table = new_table(spark, tmp_path)
    for k in range(6):
        table.merge("r", spark.createDataFrame([(f"c{k}", "p", "x")], SCHEMA))
        assert len(table.entries("r")) <= 3
    assert table.read("r").count() == 6


def test_concurrent_writers_all_land(spark, tmp_path):
    """Eight writers and a compactor at once: no delta is lost, and a reader sees whole deltas alone."""
    table = new_table(spark, tmp_path)
    table.replace("r", spark.createDataFrame([("base", "p", "x")], SCHEMA))
    errors, counts = [], []

    def run(f):
        try:
            f()
        except Exception as e:
            errors.append(e)

    def write(k):
        new_table(spark, tmp_path).merge("r", spark.createDataFrame([(f"{k}-{j}", f"p{k}", "x") for j in range(10)], SCHEMA))

    def fold():
        for _ in range(3):
            new_table(spark, tmp_path).compact("r")

    def look():
        for _ in range(6):
            counts.append(new_table(spark, tmp_path).read("r").count())

    threads = [threading.Thread(target=run, args=(f,)) for f in [*[lambda k=k: write(k) for k in range(8)], fold, look]]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and table.read("r").count() == 81 and all(n % 10 == 1 for n in counts) and counts == sorted(counts)
    assert table.versions("r") == list(range(1, table.version("r") + 1))


def test_a_name_is_given_once(spark, tmp_path):
    files, won = Files(spark), []
    threads = [threading.Thread(target=lambda k=k: files.publish(f"{tmp_path}/m/1.json", f"[{k}]") and won.append(k)) for k in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and files.read(f"{tmp_path}/m/1.json") == f"[{won[0]}]"
    assert [n for n in files.names(f"{tmp_path}/m") if not n.startswith(".")] == ["1.json"]


def test_compaction_gives_way_to_a_new_base(spark, tmp_path, monkeypatch):
    table = new_table(spark, tmp_path)
    for k in range(3):
        table.merge("r", spark.createDataFrame([(f"c{k}", "p", "x")], SCHEMA))
    write = table._write

    def slow(part, rows, kind="data"):
        out = write(part, rows, kind)
        monkeypatch.setattr(table, "_write", write)
        new_table(spark, tmp_path).replace("r", spark.createDataFrame([("new", "p", "y")], SCHEMA))
        return out

    monkeypatch.setattr(table, "_write", slow)
    table.compact("r")
    assert rows_of(table.read("r")) == [("new", "p", "y")]


def test_vacuum(spark, tmp_path):
    """What recent versions list stays; a reader that opened a version keeps its files until they are old enough."""
    table = new_table(spark, tmp_path)
    table.replace("r", spark.createDataFrame([("a", "p", "1")], SCHEMA))
    reader = table.read("r")
    table.replace("r", spark.createDataFrame([("a", "p", "2")], SCHEMA))
    assert table.vacuum("r") == 0 and rows_of(reader) == [("a", "p", "1")]
    time.sleep(0.1)
    assert table.vacuum("r", older_than=0.05) == 2
    assert rows_of(table.read("r")) == [("a", "p", "2")] and table.versions("r") == [2] and table.vacuum("none") == 0
    assert table.merge("r", spark.createDataFrame([("b", "p", "3")], SCHEMA)) == 3


def test_registry_lookup_reaches_the_files(spark, tmp_path):
    registry = store.Registry(spark, str(tmp_path / "store"))
    row = lambda repo, n: spark.createDataFrame([(repo, "sha", "2024-01-01T00:00:00+00:00", n, 1, 0, [("python", 1, n)])], C.REGISTRY)
    for k in range(3):
        registry.replace(f"r{k}", row(f"r{k}", k))
    registry.replace("r1", row("r1", 41))
    found = registry.read("r1")
    assert [r["chunk_count"] for r in found.collect()] == [41] and registry.repos() == ["r0", "r1", "r2"] and registry.read("r9").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(repo_id,r1)") >= 4  # every folder's scan


def test_two_repositories_register_at_once(spark, tmp_path):
    row = lambda repo: spark.createDataFrame([(repo, None, "t", 1, 1, 0, [])], C.REGISTRY)
    threads = [threading.Thread(target=lambda k=k: store.Registry(spark, str(tmp_path / "s")).replace(f"r{k}", row(f"r{k}"))) for k in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.Registry(spark, str(tmp_path / "s")).repos() == [f"r{k}" for k in range(5)]


def test_statistics_in_one_pass(spark):
    rows = [("python", "a.py"), ("python", "a.py"), (None, "b"), ("sql", " "), ("sql", None), ("unknown", "c")]
    df = spark.createDataFrame(rows, "language string, path string")
    found = inspect.statistics(df)
    assert {(r["language"], r["files"], r["chunks"], r["total"]) for r in found.collect()} == {("python", 1, 2, False), ("unknown", 2, 2, False), ("sql", 0, 2, False), (None, 3, 6, True)}
    assert [tuple(r) for r in inspect.statistics(df.limit(0)).collect()] in ([], [(None, 0, 0, True)])


@pytest.mark.parametrize("rows", [[], [("a", "p", "x")]])
def test_tables_without_merge_get_whole_repositories(spark, rows):
    class Plain:
        held = rows

        def read(self, repo):
            return spark.createDataFrame(self.held, SCHEMA).selectExpr("'r' as repo_id", "*")

        def replace(self, repo, new):
            self.held = [(r["id"], r["path"], r["code"]) for r in new.collect()]
            return 1

    table = Plain()
    store.merge_into(table, "r", spark.createDataFrame([("r", "b", "q", "y")], "repo_id string, id string, path string, code string"), spark.createDataFrame([("r", "p")], "repo_id string, path string"))
    assert table.held == [("b", "q", "y")]
