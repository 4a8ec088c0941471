"""Near-duplicate vectors, vector codes and spelling variants: against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkmill.llm import op11_embedding_dedup as dedup
from chunkmill.llm import op12_vector_codes as codes
from chunkmill.llm import op13_spelling as spelling

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("module, query", [(dedup, "op11_embedding_dedup"), (codes, "op12_vector_codes"), (spelling, "op13_spelling")])
def test_query_equals_its_sql(spark, module, query):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(module.SQL)
    names = [d[0] for d in found.description]
    got = getattr(module, query)(spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == sorted(found.fetchall(), key=repr)


# Near-duplicate vectors


def linked(rows, threshold=0.98):
    """(vec_id, links, component) of each row, all pairs compared."""
    fine = [i is not None and label is not None and bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v) for i, v, label in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (one, v, label) in enumerate(rows):
        for j, (other, w, same) in enumerate(rows[:i]):
            if not (fine[i] and fine[j]):
                continue
            near = label == same and len(v) == len(w) and dedup.exact_cosine(np.array(v), np.array(w)) >= threshold
            links[i] += near
            links[j] += near
            if near or one == other:
                parent[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        if fine[i]:
            least[find(i)] = min(least.get(find(i), row[0]), row[0])
    return sorted(((rows[i][0], links[i], least[find(i)] if fine[i] else rows[i][0]) for i in range(len(rows))), key=str)


def groups_of_vectors():
    rng = np.random.default_rng(0)
    rows = []
    for g in range(9):
        centre = rng.normal(size=16)
        rows += [(len(rows) + k, (centre + rng.normal(size=16) * 0.12 * rng.random()).tolist(), g % 3) for k in range(18)]
    return rows + [(len(rows) + k, rng.normal(size=16).tolist(), k % 3) for k in range(100)]


@pytest.mark.parametrize("block, sample", [(1024, 8192), (7, 40)])
def test_all_links_are_found(spark, monkeypatch, block, sample):
    """Whole lists or many blocks, a sample that holds everything or little: each link is counted once at each end."""
    monkeypatch.setattr(dedup, "BLOCK", block)
    monkeypatch.setattr(dedup, "SAMPLE", sample)
    rows, nan = groups_of_vectors(), float("nan")
    one = rows[1][1]
    rows += [(1, one, 1), (900, one, rows[1][2]), (901, [0.0] * 16, 1), (902, None, 1), (903, [1.0, None], 1), (904, [nan] * 16, 1), (905, [1.0] * 5, 1), (906, [2.0] * 5, 1), (907, [-0.0, 1.0], 1), (908, [0.0, 3.0], 1)]
    rows += [(909, [], 1), (None, one, rows[1][2]), (911, one, None), (5, rows[50][1], rows[50][2]), (912, [1e300] * 5, 1), (913, [-math.inf] * 5, 1)]
    frame = spark.createDataFrame(rows, VECTORS).withColumn("w", F.lit("x")).withColumn("id", F.lit(1)).repartition(3)
    got = dedup.near_vectors(frame).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == linked(rows)
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in got)


def test_cosine_at_the_threshold(spark):
    """Exactly 0.98 links: (50, 0, 0) and (49, 7, 7) with lengths 50 and 49.99 don't, (49, sqrt 99) does."""
    rows = [(0, [1.0, 0.0, 0.0, 0.0], 1), (1, [0.98, 0.14, 0.14, 0.02], 1), (2, [49.0, 9.0, 3.0, 3.0], 1), (3, [49.0, 9.0, 3.0, 3.0001], 1)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in dedup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == linked(rows) and dedup.exact_cosine(np.array(rows[0][1]), np.array(rows[2][1])) == 0.98 and got[0][1] >= 1


def test_no_vectors(spark):
    assert dedup.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    assert [tuple(r) for r in dedup.near_vectors(spark.createDataFrame([(3, None, 1)], VECTORS)).collect()] == [(3, 0, 3, True)]


def test_probes_and_codes_spare_pairs():
    """Of 4000 vectors of 64 dimensions in groups, probes and codes leave few pairs to score, and none that links is lost."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x[:400] = x[rng.integers(400, 440, 400)] + rng.normal(size=(400, 64)) * 0.1
    x = dedup.unit(x)
    q = dedup.fitted(x.tolist(), len(x))
    own, near = dedup.visits(q, x, dedup.reach() / 2)
    stored, miss = q.encode(x, own)
    links = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1)), strict=True)}
    probed, scored, seen = 0, 0, set()
    for cell in range(len(q.centroids)):
        d = np.flatnonzero(own == cell)
        a = np.flatnonzero(near[:, cell] | (own == cell))
        probed += len(a) * len(d)
        i, j = np.nonzero(q.distances(x[a], cell, stored[d]) <= (dedup.reach() + miss[d] + 1e-3) ** 2)
        scored += len(i)
        seen |= {(min(p), max(p)) for p in zip(a[i].tolist(), d[j].tolist(), strict=True)}
    assert links and links <= seen
    assert probed < 0.2 * len(x) ** 2 and scored < 0.02 * len(x) ** 2


# Vector codes


def coded(rows, rounds=6):
    """Codes with Python's own integers: (vec_id, code, error, label error), and the digest of the codebooks."""
    rows = [(i, v, label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(1, -(-max((len(v) for _, v, _ in rows), default=1) // 8)) * 8
    rows = [(i, [max(-(2**61), min(2**61, math.floor(4096 * c))) for c in v] + [0] * (width - len(v)), label) for i, v, label in rows]
    cut = lambda v: [v[p * width // 8 : (p + 1) * width // 8] for p in range(8)]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(8)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign(v):
        return [min((square(part, c), e) for e, c in enumerate(books[p])) for p, part in enumerate(cut(v))]

    for _ in range(rounds):
        held = defaultdict(list)
        for _, v, _ in rows:
            for p, (_, e) in enumerate(assign(v)):
                held[p, e].append(cut(v)[p])
        for (p, e), parts in held.items():
            books[p][e] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
    out = [(i, "".join(f"{e:02x}" for _, e in assign(v)), sum(d for d, _ in assign(v)), label) for i, v, label in rows]
    total = Counter()
    for _, _, error, label in out:
        total[label] += error
    most = 2**63 - 1
    said = ",".join(str(c) for p in range(8) for e in books[p] for c in e)
    return sorted(((i, code, min(error, most), min(total[label], most)) for i, code, error, label in out), key=str), hashlib.sha256(said.encode()).hexdigest()


def test_codes_equal_plain_integers(spark):
    r = random.Random(5)
    rows = [(k, [r.gauss(0, 1) for _ in range(24)], r.choice([0, 1, None])) for k in range(120)] + [(k, [0.25] * 24, 2) for k in range(120, 140)]
    rows += [(200, None, 1), (201, [None] * 24, 1), (202, [float("nan")] * 24, 1), (203, [math.inf] * 24, None)]
    frame = spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit(1)).withColumn("_label", F.lit(1)).repartition(5)
    want, sha = coded(rows)
    got = codes.compress(frame).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str) == want
    assert {r["codebooks_sha256"] for r in got} == {sha}


def test_codes_of_odd_vectors(spark):
    """Unequal lengths, few rows, equal and null ids, huge components."""
    rows = [(5, [1.0] * 8, None), (5, [0.5] * 8, 1), (5, [0.5] * 8, 1), (None, [2.0] * 3, None), (10, [1e300] * 10, 2), (11, [], 2), (12, [-1e-9] * 8, 3), (13, [3e9] * 8, 3)]
    want, sha = coded(rows)
    got = codes.compress(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str) == want and {r["codebooks_sha256"] for r in got} == {sha}
    many = [(k, [(k % 7) * 1e14, -1e15 * (k % 3), *[float(k)] * 6], k % 2) for k in range(40)]
    want, sha = coded(many)
    got = codes.compress(spark.createDataFrame(many, VECTORS)).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str) == want and {r["codebooks_sha256"] for r in got} == {sha}
    assert codes.compress(spark.createDataFrame([], VECTORS)).collect() == []


# Spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def spelled(rows):
    """(word, form, root, n, n_near, form_n), all pairs compared."""
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= 6
    count = {w: n for w, n in count.items() if n >= 5}
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 5 * count[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n, len(near[w]), count.get(form[w])) for w, n in count.items()), key=str)


def test_spelling_variants(spark):
    """Words of two and three letters in all lengths, so that every kind of edit occurs at every place; a chain of forms; accents and signs."""
    r = random.Random(1)
    words = ["".join(r.choice("abé") for _ in range(r.randrange(5, 10))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(40)) for _ in range(150)]
    texts += ["colours " * 700, "colour, " * 130, "Kolour\n" * 25, "kolourr-" * 5, "NAÏVELY naïvely ×÷×÷×÷ " * 6, "x" * 50_000, "", None, "short words are no words", "colours_colour9"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).repartition(4)
    got = sorted((tuple(x) for x in spelling.variants(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    assert got == spelled(rows)
    assert any(row[2] not in (row[0], row[1]) for row in got) and sum(row[4] for row in got) > 100


def test_no_words(spark):
    for rows in ([], [(1, None)], [(1, "a b c")]):
        assert spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []


def test_neighbourhood_is_whole_and_distinct(spark):
    """Each string one edit away is made once."""
    words = ["aabbaa", "abcabca"]
    made = spelling.edits(spelling.sources(spark.createDataFrame([(w, 5) for w in words], "word string, n long")), ["a", "b", "c"])
    got = sorted((r["word"], r["near"]) for r in made.collect())
    want = set()
    for w in words:
        for k in range(len(w) + 1):
            want |= {(w, w[:k] + c + w[k:]) for c in "abc"} | ({(w, w[:k] + w[k + 1 :])} | {(w, w[:k] + c + w[k + 1 :]) for c in "abc"} if k < len(w) else set())
    assert got == sorted(want - {(w, w) for w in words})


def test_the_strings_are_not_shuffled(spark):
    """Edits are made after words were dealt by the half that stays, and meet the vocabulary there."""
    words = spark.createDataFrame([("aabbaa", 5), ("aabbab", 7)], "word string, n long")
    with spelling.joined_by_part_of_the_key(spark):
        made = spelling.edits(spelling.sources(words).repartition(4, "key"), ["a", "b"])
        known = spelling.targets(words).repartition(4, "key").withColumnRenamed("word", "near").hint("shuffle_hash")
        plan = made.join(known, ["key", "near"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "ShuffledHashJoin" in plan
