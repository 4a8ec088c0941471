"""Listing a tree with pushed filters, vectors by content, and the trigram index."""

import os
import random

import pytest
from pyspark.sql import functions as F

from chunkmill.operators import text_index
from chunkmill.operators.symbol import symbol_search
from chunkmill.operators.text_index import TextIndex, trigrams
from chunkmill.service import Service
from chunkmill.sources import repo_files as source
from chunkmill.sources.embed import HashEmbedder
from chunkmill.sources.vectors import Vectors

TREE = {
    "top.py": "x = 1\n", "a/one.py": "def one(): pass\n", "a/deep/er/two.ts": "function two() {}\n", "a/big.js": "/" * 1_000_001, "b/__init__.py": "# b\n", "b/.dot.py": "y = 2\n", "b/blob.cs": "a\0b",
    "b/notes.txt": "n", "node_modules/m.js": "function m() {}\n", ".venv/v.py": "z = 3\n", "a/build/out.js": "function o() {}\n", "a/.hidden/h.py": "w = 4\n", "empty/.keep": "",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in TREE.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(text)
    os.symlink(tmp_path / "tree" / "a", tmp_path / "tree" / "link")
    return str(tmp_path / "tree")


def test_listing_and_contents(spark, tree):
    listed = {r["path"]: (r["language"], r["skipped"]) for r in source.listed_files(spark, tree).collect()}
    assert listed == {
        "top.py": ("python", None), "a/one.py": ("python", None), "a/deep/er/two.ts": ("typescript", None), "a/big.js": ("javascript", "too_large"), "b/__init__.py": ("python", None), "b/.dot.py": ("python", None),
        "b/blob.cs": ("csharp", None), "b/notes.txt": (None, "unsupported"), "empty/.keep": (None, "unsupported"),
    }
    read = {r["path"]: (r["content"] and bytes(r["content"]).decode(), r["skipped"]) for r in source.repo_files(spark, tree).collect()}
    assert read == {p: (TREE[p] if s is None and p != "b/blob.cs" else None, "binary" if p == "b/blob.cs" else s) for p, (_, s) in listed.items()}
    assert source.listed_files(spark, tree + "/nowhere").count() == 0


def test_the_driver_lists_the_top_level(tree, monkeypatch):
    opened, scan = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda at=".": opened.append(str(at)) or scan(at))
    reader = source._Reader({"path": tree})
    parts = reader.partitions()
    assert opened == [tree] and sorted(p.folder for p in parts if p.folder) == ["a", "b", "empty"] and [p.paths for p in parts if not p.folder] == [["top.py"]]


def test_filters_reach_the_source(spark, tree):
    """Pushed filters are in the plan and not in a Filter above it; what is left is as if they had been applied afterwards."""
    rows = source.listed_files(spark, tree)
    for where in (F.col("path").startswith("a/deep/"), F.col("language") == "python", F.col("path").isin("top.py", "b/notes.txt", "gone.py"), (F.col("path").startswith("b/")) & F.col("language").isin("python", "csharp") & (F.col("size") > 4)):
        want = sorted(r["path"] for r in spark.createDataFrame(rows.collect(), rows.schema).where(where).collect())
        got = rows.where(where)
        assert sorted(r["path"] for r in got.collect()) == want and want
        assert source.repo_files(spark, tree, where=where).count() == len(want)
    plan = rows.where(F.col("path").startswith("a/deep/") & (F.col("language") == "typescript"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan repo_files" in plan and "Filter (" not in plan
    assert "Filter (" in rows.where("size > 4")._jdf.queryExecution().executedPlan().toString()


def test_filters_prune_folders(tree):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    reader = source._Reader({"path": tree})
    kept = list(reader.pushFilters([StringStartsWith(("path",), "a/deep/"), GreaterThan(("size",), 3), EqualTo(("language",), "typescript"), In(("path",), ("a/deep/er/two.ts", "top.py"))]))
    assert [type(f) for f in kept] == [GreaterThan]
    parts = reader.partitions()
    assert [p.folder for p in parts if p.folder] == ["a"] and [r[0] for p in parts for r in reader.read(p)] == ["a/deep/er/two.ts"]
    assert not reader.wanted.folder("a/build/") and reader.wanted.folder("a/") and reader.wanted.folder("a/deep/er/")


# Vectors by content


def counting(path, dim=8):
    """An embedder that notes each text that it is asked for in a file, since tasks run elsewhere."""

    class Counting(HashEmbedder):
        def embed(self, texts):
            with open(path, "a") as out:
                out.writelines(repr(t) + "\n" for t in texts)
            return super().embed(texts)

    return Counting(dim)


def asked(path):
    return sorted(open(path).read().splitlines()) if os.path.exists(path) else []


def test_texts_are_embedded_once(spark, tmp_path):
    log = str(tmp_path / "asked")
    embedder = counting(log)
    vectors = Vectors(spark, str(tmp_path / "store"), embedder)
    rows = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, None), (5, "")], "n int, text string").repartition(3)
    got = {r["n"]: list(r["vector"]) for r in vectors.embed(rows).collect()}
    assert asked(log) == ["''", "'one'", "'two'"]
    assert got[1] == got[3] == pytest.approx(HashEmbedder(8).embed(["one"])[0]) and got[4] == got[5] and len(got) == 5
    more = spark.createDataFrame([(6, "two"), (7, "three")], "n int, text string")
    assert vectors.embed(more).count() == 2 and asked(log) == ["''", "'one'", "'three'", "'two'"]
    other = Vectors(spark, str(tmp_path / "store"), counting(log, 4))
    assert len(other.embed(more).first()["vector"]) == 4 and len(asked(log)) == 6  # another model
    assert vectors.embed(more.limit(0)).count() == 0


def test_an_unchanged_tree_is_not_embedded_again(spark, tree, tmp_path):
    service = Service(spark, str(tmp_path / "store"), counting(str(tmp_path / "asked")))
    first = service.index(tree, "r")
    calls = len(asked(tmp_path / "asked"))
    before = sorted(map(tuple, service.chunks.read("r").select("id", "vector").collect()), key=repr)
    assert calls > 0 and service.index(tree, "r")["chunks"] == first["chunks"] and len(asked(tmp_path / "asked")) == calls
    assert sorted(map(tuple, service.chunks.read("r").select("id", "vector").collect()), key=repr) == before
    with open(os.path.join(tree, "top.py"), "w") as out:
        out.write("x = 5\n")
    service.index(tree, "r", ["top.py"])
    assert len(asked(tmp_path / "asked")) == calls + 1


# Trigram index


def test_trigrams_of_words():
    assert trigrams("ab") == ["<ab", "ab>"] and trigrams("x") == ["<x>"] and trigrams("a.bc") == ["<a>", "<bc", "bc>"] and trigrams("$-") == []


def test_blocks_that_cannot_hold_the_word_are_not_read(spark, tmp_path):
    """Over words of few letters, so that trigrams also lead to blocks in vain; identifiers that begin, end or have only signs."""
    r = random.Random(2)
    rows = [(k, f"d{k // 40:02d}/f{k}", "\n".join(" ".join("".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(4)) + f" only_{k} g{k // 40}" for _ in range(3))) for k in range(400)]
    rows += [(900, "d99/x", "a.b$c $x\nfin"), (901, "d99/y", None), (902, "d99/z", "")]
    files = spark.createDataFrame(rows, "n int, path string, text string").repartition(5)
    index = TextIndex.build(files, str(tmp_path / "index"), "path", block_rows=20)
    total = len([n for n in os.listdir(tmp_path / "index" / "blocks") if n.endswith(".parquet")])
    for word in ("abc", "only_7", "g3", "a", "abcab", "nowhere", "a.b$c", "$x", "$", "b c", "only"):
        found = sorted((x["n"], x["line_no"], x["line"]) for x in index.search(word).collect())
        assert found == sorted((x["n"], x["line_no"], x["line"]) for x in symbol_search(files, word).collect()), word
    assert total >= 20 and index.candidates("$") is None
    assert len(index.candidates("only_7")) <= 2 and len(index.candidates("g3")) <= 4 and index.candidates("nowhere") == []
    plan = index.search("g3")._jdf.queryExecution().optimizedPlan().toString() and index.search("g3").inputFiles()
    assert len(plan) <= 0.2 * total


def test_share_of_blocks_read(spark, tmp_path):
    """Words of the tables, frequent and rare: the lines are those of the plain search, and few blocks are opened that don't hold the word."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    index = TextIndex.build(docs, str(tmp_path / "index"), "lang", block_rows=25)
    total = len(index.blocks().inputFiles())
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "[^A-Za-z0-9_]+"))).alias("w")).where("length(w) > 5").groupBy("w").agg(F.count("*").alias("n"))
    rare = [r["w"] for r in words.where("n = 2").orderBy(F.xxhash64("w")).limit(4).collect()]
    holding = index.blocks().select(F.col("_metadata.file_name").alias("block"), "text")
    for word in ("the", "und", *rare):
        lines = symbol_search(docs, word).count()
        held = symbol_search(holding, word).select("block").distinct().count()
        assert index.search(word).count() == lines > 0
        assert held <= len(index.candidates(word)) <= (0.2 * total if word in rare else total)
    assert text_index.BLOCK_ROWS > 25


def test_rows_of_one_language_are_sorted_in_many_tasks(spark, tmp_path):
    """Nine tenths of the rows agree in the column that blocks are ordered by; no task writes more than its share, and the order holds."""
    files = spark.range(2000).select("id", F.when(F.col("id") % 10 > 0, "en").otherwise("de").alias("lang"), F.concat(F.lit("word "), "id").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        index = TextIndex.build(files, str(tmp_path / "index"), "lang", block_rows=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    task = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1)
    rows = index.blocks().groupBy(task.alias("task")).agg(F.count("*").alias("n"), F.min("lang").alias("low"), F.max("lang").alias("high")).orderBy("task").collect()
    assert max(r["n"] for r in rows) < 1000 and all(a["high"] <= b["low"] for a, b in zip(rows, rows[1:]))
    assert index.search("word").count() == 2000


def test_index_of_nothing(spark, tmp_path):
    index = TextIndex.build(spark.createDataFrame([], "path string, text string"), str(tmp_path / "index"), "path")
    assert index.search("x").count() == 0 and index.search("$").count() == 0
