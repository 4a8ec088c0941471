import random
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkmill.functions import scalar as S
from chunkmill.operators import search


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"])
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("path", "language"), [("a/b/foo.py", "python"), ("Foo.cs", "csharp"), ("x.JS", "javascript"), ("x.ts", "typescript"), ("comp.tsx", "tsx"), ("README.md", None), ("Makefile", None), ("a.b/Makefile", None)])
def test_language_for(spark, path, language):
    assert one(spark, S.language_for(F.col("p")), p=path) == language


def test_chunk_id_is_uuid5(spark):
    got = one(spark, S.chunk_id(F.col("r"), F.col("p"), F.col("a"), F.col("b")), r="r-1", p="ä/x.py", a=3, b=99)
    assert got == str(uuid.uuid5(uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8"), "r-1:ä/x.py:3:99"))


def test_slug_and_repo_id(spark):
    assert one(spark, S.slug(F.col("n")), n="My Repo!!") == "my-repo"
    assert one(spark, S.slug(F.col("n")), n="___") == "repo"
    from chunkmill.service import id_of_root

    assert one(spark, S.repo_id(F.col("n")), n="/srv/My Repo/") == id_of_root("/srv/My Repo")["repo_id"]


def test_query_tokens():
    assert {"orderservice", "publish", "an", "order"} <= set(S.query_tokens("OrderService publish an order"))
    assert S.query_tokens("") == []


def test_nonblank_lines(spark):
    text = "a\r\n\n  \nb\x0bc\u2028 \td"
    assert one(spark, S.nonblank_lines(F.col("t")), t=text) == sum(bool(x.strip()) for x in text.splitlines())


def test_percent_is_half_even(spark):
    assert one(spark, S.saved_percent(F.col("s"), F.col("b")), s=25, b=1000) == 2
    assert one(spark, S.saved_percent(F.col("s"), F.col("b")), s=35, b=1000) == 4
    assert one(spark, S.saved_percent(F.col("s"), F.col("b")), s=5, b=0) == 0


@pytest.mark.parametrize(("path", "pattern", "hit"), [("a/b/__init__.py", "**/__init__.py", True), ("__init__.py", "**/__init__.py", False), ("A/X.PY", "a/?.py", True), ("a.py", "a+py", False), ("a.py", "  ", False)])
def test_globs(spark, path, pattern, hit):
    assert one(spark, S.matches_any(F.col("p"), F.array("g")), p=path, g=pattern) is hit


def test_normal_path(spark):
    assert one(spark, S.normal_path(F.col("p")), p="././a\\b") == "a/b"


def fold(rows):
    """Plain model of the greedy collapse."""
    kept = []
    for r in sorted(rows, key=lambda r: r[3]):
        for k in kept:
            if k[0] != r[0]:
                continue
            (a, b), (c, d) = sorted(k[1:3]), sorted(r[1:3])
            overlap = min(b, d) - max(a, c) + 1
            if overlap > 0 and ((a <= c and b >= d) or (c <= a and d >= b) or 2 * overlap > min(b - a, d - c) + 1):
                break
        else:
            kept.append(r)
    return sorted(k[3] for k in kept)


def test_collapse_against_model(spark):
    random.seed(5)
    rows = [(f"p{random.randrange(4)}", random.randrange(40), random.randrange(40), k) for k in range(200)]
    df = spark.createDataFrame(rows, "path string, start_line int, end_line int, rank int")
    assert sorted(r["rank"] for r in search.collapse(df, ("path",)).collect()) == fold(rows)


@pytest.mark.parametrize(("second", "stays"), [((20, 29), True), ((6, 15), True), ((5, 14), False), ((11, 20), True), ((9, 2), False)])
def test_collapse_borders(spark, second, stays):
    df = spark.createDataFrame([("p", 1, 10, 1), ("p", *second, 2)], "path string, start_line int, end_line int, rank int")
    assert search.collapse(df, ("path",)).count() == 1 + stays


@settings(max_examples=10, deadline=None)
@given(st.text(max_size=40))
def test_tokens_are_words(text):
    assert all(t and t == t.lower() for t in S.query_tokens(text))
