"""Decontamination, archives, token files, mixing, near-duplicates and repeated strings: against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkmill.llm import op3_decontaminate as fm
from chunkmill.llm import op4_warc as warc
from chunkmill.llm import op6_tokens as tok
from chunkmill.llm import op7_mixing as mixing
from chunkmill.llm import op8_minhash as near
from chunkmill.llm import op9_suffix_dedup as suffix
from chunkmill.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, a string, b string, rank int"


def docs(spark, texts, sources=None, parts=3):
    rows = [(k, t, "en", sources[k] if sources else "s", "x", "y", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def prose(seed, n, size=60):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


# Decontamination


def test_suffix_array_and_search():
    r = random.Random(2)
    for _ in range(30):
        runs = [[r.randrange(1, 4) for _ in range(r.randrange(1, 30))] for _ in range(r.randrange(1, 6))]
        text = np.array([x for run in runs for x in [*run, 0]])
        end = text == 0
        index = fm.FMIndex(text, end, 3, sample=4)
        patterns = [[r.randrange(1, 4) for _ in range(r.randrange(1, 5))] for _ in range(20)]
        padded = np.array([p + [0] * (5 - len(p)) for p in patterns])
        which, low, high = index.search(padded, np.array([len(p) for p in patterns]))
        got = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high, strict=True)}
        want = {k: [i for i in range(len(text)) if text[i : i + len(p)].tolist() == p] for k, p in enumerate(patterns)}
        assert got == {k: v for k, v in want.items() if v}


def hits(text, items, size=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hit, found = set(), set()
    for item, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        for k in range(max(1, len(v) - size + 1) if v else 0):
            x = v[k : k + size]
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("block_words", [fm.BLOCK_WORDS, 7])
def test_decontamination(spark, monkeypatch, block_words):
    prepare = fm.prepare
    monkeypatch.setattr(fm, "prepare", lambda b, size: prepare(b.repartition(3), size, block_words))
    items = [(k, prose(k, 14 + k)) for k in range(6)] + [(10, "Short É item"), (11, None), (12, " .. "), (3, prose(50, 12)), (2, prose(2, 16))]
    texts = [prose(100, 50) + ", " + prose(1, 15).upper() + "! " + prose(101, 5), prose(3, 17), None, "", "..", "short é ITEM short é item", prose(102, 3000), prose(2, 9), prose(4, 18) + " " + prose(4, 18), prose(50, 12)] + [prose(5, 19)] * 3
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in fm.contamination(docs(spark, texts), bench).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == hits(t, items), k
        assert r["contaminated"] == (r["n_hit"] > 0)
        if r["spans"]:
            assert hits(fm.remove_spans(t, r["spans"]), [])[0] == r["n_words"] - r["n_hit"]
    clean = fm.drop_contaminated(docs(spark, texts), bench)
    assert clean.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert {r["doc_id"] for r in clean.collect()} == {k for k in got if not got[k]["contaminated"]}


def test_clashing_columns_pass_or_are_replaced(spark):
    """Columns of any name pass through the stages; what an operator adds replaces a column of that name."""
    frame = docs(spark, ["a b c d e f g h i j k"] * 3).withColumn("spans", F.lit("mine")).withColumn("__mix_key", F.lit("k")).withColumn("score", F.lit("s")).withColumn("key", F.lit(7)).withColumn("row", F.lit("r")).withColumn("copies", F.lit(0))
    bench = spark.createDataFrame([(1, "b c d e f g h i j k l")], "item_id long, text string")
    assert fm.contamination(frame, bench).first()["spans"] == "1:11"
    clean = fm.drop_contaminated(frame, bench.where("item_id > 1"))
    assert clean.columns == frame.columns and clean.first()["spans"] == "mine"
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and {(r["__mix_key"], r["key"], r["row"], r["copies"]) for r in mixed.collect()} == {("k", 7, "r", 0)}
    assert near.keep_one(frame).columns == frame.columns
    from chunkmill.llm import op10_language as language

    assert language.predict(frame, None).first()["score"] == 0.0 and language.keep_identified(frame).columns == frame.columns


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert fm.contamination(docs(spark, ["a b"]), none).first()["contaminated"] is False
    assert fm.contamination(docs(spark, []), none).count() == 0


# Archives


def test_archives(spark):
    big = "é" * 600
    rows = [(1, "http://a/ b", big, "x"), (5, "http://c", big, "x"), (3, None, big, "x"), (2, "http://d", "small", "x"), (4, "http://d", "small", "x"), (6, "u", None, "x"), (None, "u", big, "x"), (7, "v", "z" * 300_000, "x"), (8, "v", "\r\n\r\n" * 400, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string").repartition(3)
    got = {r["page_id"]: r for r in warc.read_records(warc.write_archives(pages, file_bytes=200)).collect()}
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        r = got[page_id]
        revisit = html == big and page_id != 5
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 5) if revisit else ("response", None))


def test_hot_payloads_are_looked_up(spark, monkeypatch):
    rows = [(k, "u", "h" * 2000 if k % 3 == 0 else f"{k}" * 1000) for k in range(3300)]
    got = warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got.count() == 3300 and got.where("refers_to = 3297").count() == 1099 and got.where("refers_to is not null").count() == 1099


def test_joined_ranges():
    got = list(warc.joined_ranges([(0, 10), (10, 5), (100, 5), (130, 50), (500, 10)], gap=30, most=100))
    assert [(a, n) for a, n, _ in got] == [(0, 15), (100, 80), (500, 10)]
    assert list(warc.joined_ranges([])) == []


# Token files


def test_codes():
    ids = np.array([0, 255, 256, 65535, 65536, 2**32 - 1] * 300 + [7], np.uint32)
    r = tok.Reader(tok.encode(ids))
    assert [r.token(i) for i in range(len(ids))] == ids.tolist()
    for a, b in [(0, len(ids)), (5, 5), (511, 1025), (17, 18)]:
        assert r.slice(a, b).tolist() == ids[a:b].tolist()
    assert tok.Reader(tok.encode(np.zeros(0, np.uint32))).size == 0


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = tok.tokenizer_path()
    plain = Tokenizer.from_file(path)
    texts = ["Hello, world.", None, "", "a  b\n\n c\t d ", "x <|endoftext|> y", "It's 2024, isn't it?\nYes. 　ok", "日本語 é́ 😀 ok"] + [prose(k, 200) for k in range(20)]
    got = {r["doc_id"]: r for r in tok.read_back(tok.write_tokens(docs(spark, texts), path, file_tokens=500)).collect()}
    start = 0
    for k, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)
    again = docs(spark, ["a", "a"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r["start"] for r in tok.read_back(tok.write_tokens(again, path)).collect()) == [0, 2]
    assert tok.read_back(tok.write_tokens(docs(spark, []), path)).count() == 0


def test_pieces_equal_the_tokenizer(monkeypatch):
    """Odd white space, contractions, marks, special strings and text borders: the cut texts against whole ones."""
    from tokenizers import Tokenizer

    path = tok.tokenizer_path()
    plain, coder, r = Tokenizer.from_file(path), tok.PieceEncoder(path), random.Random(6)
    parts = [*"ab'sStTrRvVlLdDmM  \n\n\t,.!?-_()12é日äß×÷Öя\u0085\xa0\u3000\u2003\u200b\u180e\x1c\x1f\x0b\x0c\r\x00\x7f", "'s", "'re", " '", "<|endoftext|>", "<|", "ſ", " \n", "  ", "😀", "¿", "“"]
    for k in range(150):
        if k == 75:
            monkeypatch.setattr(tok, "CACHE_PIECES", 50)
        texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(60)]
        got, n = coder.encode([t.encode() for t in texts], 2)
        want = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert n.tolist() == [len(w) for w in want] and got.tolist() == [i for w in want for i in w]
    none, n = coder.encode([])
    assert len(none) == len(n) == 0


def test_other_tokenizers_see_whole_texts():
    from tokenizers import Tokenizer

    path = tok.tokenizer_path("word_bpe_49k.json")
    texts = ["It's  a test, é!", "", "b\nc"]
    got, n = tok.PieceEncoder(path).encode([t.encode() for t in texts])
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and got.tolist() == [i for w in want for i in w]


def test_a_token_is_read_by_short_ranges(tmp_path):
    ids = np.arange(200_000, dtype=np.uint32)
    data, asked = tok.encode(ids), []
    reader = tok.Reader(lambda at, n: asked.append(n) or data[at : at + n])
    assert [reader.token(i) for i in (0, 255, 70_000, 199_999)] == [0, 255, 70_000, 199_999]
    assert reader.slice(65_530, 65_540).tolist() == list(range(65_530, 65_540)) and max(asked) < 200
    (tmp_path / "x.dac").write_bytes(data)
    assert tok.open_tokens(str(tmp_path / "x.dac")).token(123_456) == 123_456


# Mixing


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(out.values())
        level = left / sum(w[s] for s in free)
        above = [s for s in free if level * w[s] > most * sizes[s]]
        for s in above or list(free):
            out[s] = most * sizes[s] if above else level * w[s]
            free.discard(s)
    return out


@pytest.mark.parametrize("block", [mixing.BLOCK_ROWS, 5])
def test_mixing(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    r = random.Random(9)
    texts = [" ".join(["w"] * r.randrange(1, 60)) for _ in range(300)] + [None, "", " \t ", "x"]
    sources = [r.choice(["a", "a", "a", "b", "é", "Z", None]) for _ in texts]
    every = docs(spark, texts, sources)
    got = mixing.decide(every).collect()
    assert len(got) == len(texts)
    sizes = defaultdict(int)
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len((t or "").split())
    want, taken = water(dict(sizes)), Counter()
    for row in got:
        assert row["source_size"] == sizes[row["source"]] and abs(row["target"] - want[row["source"]]) < 1e-6
        assert 0 <= row["copies"] <= 2
        taken[row["source"]] += row["copies"] * row["size"]
    assert all(abs(taken[s] - want[s]) <= 61 for s in sizes)
    again = mixing.decide(docs(spark, texts, sources, 7)).collect()
    assert {r["doc_id"]: r["copies"] for r in again} == {r["doc_id"]: r["copies"] for r in got}
    mixed = mixing.mix(every)
    assert mixed.columns == every.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_pivot_keeps_mass_and_expectation():
    masses, probs = [3, 5, 2, 9, 4, 0], [0.3, 0.6, 0.5, 0.2, 0.9, 0.5]
    total = np.zeros(6)
    for seed in range(3000):
        out = mixing.pivot(list(range(10, 16)), masses, probs, seed)
        assert abs(sum(m * p for m, p in zip(masses, out, strict=True)) - sum(m * p for m, p in zip(masses, probs, strict=True))) < 1e-9
        assert sum(0 < p < 1 for p in out) <= 1
        total += out
    assert np.abs(total / 3000 - probs).max() < 0.04


def test_mixing_of_nothing_and_repeats(spark):
    assert mixing.decide(docs(spark, [])).count() == 0
    same = docs(spark, ["a b c"] * 4).withColumn("doc_id", F.lit(1).cast("long"))
    (row,) = mixing.decide(same).collect()
    assert (row["n_rows"], row["source_size"]) == (4, 12)


# Near-duplicates


def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def groups(texts):
    sets = shingle_sets(texts)
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return [len(s) for s in sets], label


def edited(text, seed, share):
    r = random.Random(seed)
    w = text.split()
    for _ in range(int(len(w) * share)):
        w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [near.BLOCK_ROWS, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK_ROWS", block)
    monkeypatch.setattr(near, "CHUNK", 4)
    base = [prose(k, 150, 5000) for k in range(8)]
    texts = list(base) + [None, "", " ", "one two", "ONE  Two", "a b c d e", "a b c d e", base[0].upper(), base[0]]
    for k in range(3):
        texts += [edited(base[k], 10 * k + j, s) for j, s in enumerate((0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08))]
    chain = base[5]
    for j in range(12):  # each near the one before, the ends far apart
        chain = edited(chain, 900 + j, 0.02)
        texts.append(chain)
    sizes, label = groups(texts)
    got = {r["doc_id"]: r for r in near.near_duplicates(docs(spark, texts)).collect()}
    assert [got[k]["n_shingles"] for k in range(len(texts))] == sizes
    assert [got[k]["component_id"] for k in range(len(texts))] == label
    assert all(got[k]["kept"] == (label[k] == k) for k in got)
    kept = near.keep_one(docs(spark, texts))
    assert kept.columns == docs(spark, texts).columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_near_duplicates_odd_rows(spark):
    assert near.near_duplicates(docs(spark, [])).count() == 0
    long = prose(1, 60_000, 10**6)
    odd = docs(spark, [long, long + " tail", "x y"]).unionByName(docs(spark, ["x y", "q"]).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs(spark, [long]))
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(0, 0, True), (0, 0, True), (1, 0, False), (2, 2, True), (None, None, True), (None, None, True)], key=str)
    assert near.keep_one(odd).count() == 4


def test_a_passage_in_many_texts(spark, monkeypatch):
    """120 different texts share a passage and so buckets; a few near copies are among them. Split buckets find the links, with fewer rows than blocks of all pairs."""
    monkeypatch.setattr(near, "BLOCK_ROWS", 4)
    passage = prose(1, 120, 5000)
    texts = [passage + " " + prose(100 + k, 60, 10**6) for k in range(120)]
    texts += [edited(texts[k], k, 0.02) for k in (3, 40, 77)]
    frame = docs(spark, texts)
    seen, plain = [], near._open_rows

    def counted(*a):
        rows = plain(*a)
        seen.append(rows.agg(F.max("depth"), F.count("*")).first())  # while the tables that it reads are there
        return rows

    monkeypatch.setattr(near, "_open_rows", counted)
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(frame).collect()}
    assert [got[k] for k in range(len(texts))] == groups(texts)[1]
    assert seen[0][0] > 1
    monkeypatch.setattr(near, "DEPTH", 1)
    assert {r["doc_id"]: r["component_id"] for r in near.near_duplicates(frame).collect()} == got
    assert seen[0][1] < seen[1][1]


def apart(text, band, seed, bands, edits=5):
    """The text with a few words changed, chosen such that hardly any band but this one stays."""
    r, own, out = random.Random(seed), bands(text), text
    for _ in range(edits):
        tried = []
        for _ in range(80):
            w = out.split()
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
            same = (bands(" ".join(w)) == own).all(1)
            tried.append((not same[band], int(same.sum()), " ".join(w)))
        out = min(tried)[2]
    return out


def test_links_in_one_crowded_bucket_alone(spark, monkeypatch):
    """Pairs that link and share no band but one, whose bucket is split: splitting alone passes them over."""
    monkeypatch.setattr(near, "BLOCK_ROWS", 4)
    bands = lambda t: np.frombuffer(near.signature(near.shingles(t.encode())), "<u2").reshape(near.BANDS, -1)
    passage = prose(1, 120, 5000)
    texts = [passage + " " + prose(100 + k, 60, 10**6) for k in range(120)]
    every = np.array([bands(t) for t in texts])
    pairs = 0
    for seed in (0, 2, 4, 10):
        own = bands(x := passage + " " + prose(10_000 + seed, 60, 10**6))
        rows = (every == own).all(2).sum(0)
        band = int(rows[:-1].argmax())
        y = apart(x, band, seed, bands)
        assert rows[band] > near.MANY_BLOCKS * 4 and np.flatnonzero((bands(y) == own).all(1)).tolist() == [band]
        pairs += near.is_link(near.shingles(x.encode()), near.shingles(y.encode()))
        texts += [x, y]
    assert pairs == 4
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == groups(texts)[1]


def test_crowded_buckets_in_the_pipeline(spark, monkeypatch):
    """Rows of crowded buckets grow with the texts, not with their square; near copies led by another text aren't linked in all pairs; the stage keeps one of each."""
    import corpus_pipeline

    monkeypatch.setattr(near, "BLOCK_ROWS", 4)
    passage = prose(1, 120, 5000)
    dealt, edges, plain, join = [], [], near._open_rows, near.components

    def counted(*a):
        rows = plain(*a)
        dealt.append(rows.where("depth > 1").count())  # while the tables that it reads are there
        return rows

    monkeypatch.setattr(near, "_open_rows", counted)
    monkeypatch.setattr(near, "components", lambda links: edges.append(links.count()) or join(links))
    for n in (60, 120):
        texts = [passage + " " + prose(100 + k, 60, 10**6) for k in range(n)]
        texts += [edited(texts[7], k, 0.01) for k in range(n // 2)] + [edited(texts[k], k, 0.02) for k in range(20, 30)]
        label = groups(texts)[1]
        assert label.count(7) > n // 2.5
        kept = corpus_pipeline.near_duplicates(spark, docs(spark, texts), "").select("doc_id").collect()
        assert sorted(r["doc_id"] for r in kept) == sorted(set(label))
        assert max(edges) < 3 * len(texts)
    assert dealt[1] <= 2.5 * dealt[0] + 100, dealt


def test_prefixes_of_sets_that_link_meet():
    """Whatever the counters hold, sets that link share a hash of their prefixes, and its places leave the pair."""
    r = np.random.default_rng(3)
    links = 0
    for k in range(300):
        every = np.sort(r.choice(1 << 40, 60, replace=False).astype(np.uint64))
        one, two = (np.sort(r.choice(every, r.integers(50, 61), replace=False)) for _ in range(2))
        counts = r.integers(0, 1 + k % 5, near.SLOTS)
        a, b = near.prefix(one, counts), near.prefix(two, counts)
        both = [(i, int(np.flatnonzero(b == h)[0])) for i, h in enumerate(a.tolist()) if h in b]
        if near.is_link(one, two):
            links += 1
            sides = np.array([True, False]), np.array([False, True]), np.array([len(one), len(two)])
            assert both and [o.tolist() for _, o in near.able(np.array([1, 2]), *sides, np.array(both[0]))] == [[1]]
    assert 50 < links < 300


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    """Texts of 1 MB that share most bands in no component: a block holds a few of them, not BLOCK_ROWS, and the links are found."""
    monkeypatch.setattr(near, "BLOCK_BYTES", 3 << 20)
    monkeypatch.setattr(near, "SALT_ROWS", 3)
    passage = prose(1, 118_000, 10**6)
    texts = [passage + " " + prose(50 + k, 60_000, 10**6) for k in range(9)]
    texts += [edited(texts[k], k, 0.01) for k in (2, 5)]
    assert min(map(len, texts)) > 1 << 20
    seen, plain = [], near._open_rows

    def counted(members, *rest):
        rows = plain(members, *rest)
        sizes = members.select("rep", "size").distinct()
        side = lambda which: rows.where(which).join(sizes, "rep").groupBy("key", "q", "d").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        seen.extend((r["bytes"], r["n"]) for which in ("asks", "answers") for r in side(which).collect())
        return rows

    monkeypatch.setattr(near, "_open_rows", counted)
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == groups(texts)[1]
    assert seen and max(n for _, n in seen) <= 7 and sum(b for b, _ in seen) / len(seen) < 5 << 20


def test_one_doc_id_with_two_texts(spark):
    """Rows that differ stay, rows that repeat go."""
    frame = docs(spark, ["a b c d e f", "g h i j k l", "a b c d e f"]).withColumn("doc_id", F.lit(1).cast("long"))
    assert sorted(r["text"] for r in near.keep_one(frame).collect()) == ["a b c d e f", "g h i j k l"]


def test_sequential_test():
    assert near.least_matches(128) < 96 and near.least_matches(32) <= 16
    x = np.arange(near.HASHES, dtype=np.uint16)[None].repeat(3, 0)
    y = x.copy()
    y[1, ::2] += 1
    y[2] += 1000
    alive, equal = near.likely(x, y)
    assert alive.tolist() == [0] and equal.tolist() == [128]


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5)]
    label = {n: n for e in edges for n in e}
    for a, b in edges * 60:
        label[a] = label[b] = min(label[a], label[b])
    loops = {5} - {n for e in edges if e[0] != e[1] for n in e}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if k in got} and set(label) - set(got) <= {n for a, b in edges if a == b for n in (a,)} | loops


# Repeated strings


def removed(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("shard", "piece", "block"), [(suffix.SHARD_BYTES, suffix.PIECE_BYTES, suffix.BLOCK_BYTES), (3000, 1000, 2000), (2000, 700, 100)])
def test_repeats(spark, monkeypatch, shard, piece, block):
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix, "PIECE_BYTES", piece)
    monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 4 * block)
    base, passage = prose(1, 300, 5000), prose(2, 70, 5000)
    exact = prose(3, 100, 5000)[:200]
    texts = [base, None, "", "short", base, base[:500] + "x" + base[501:], passage + prose(4, 40), prose(5, 40) + passage, "ab" * 400, "c" * 199, "d" * 200, "d" * 201, "é" * 150, prose(6, 30) + exact + "!", exact + "?", exact[:199], prose(7, 500, 5000), passage[:300] + "é" + passage]
    got = {r["doc_id"]: r for r in suffix.remove_repeats(docs(spark, texts), with_text=True).collect()}
    for k, want in enumerate(removed(texts)):
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, (k, texts[k] and texts[k][:30])
        assert hashlib.sha256(r["kept"]).hexdigest() == want[3]


@pytest.mark.parametrize(("bucket", "cut"), [(20_000, True), (2_000_000, False)])
def test_bucket_over_many_blocks(spark, monkeypatch, bucket, cut):
    """One passage in 1500 different surroundings: its owners' buckets span blocks and partitions, and only what repeats goes."""
    monkeypatch.setattr(suffix, "BLOCK_BYTES", bucket // 4)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", bucket)
    r, passage = random.Random(5), prose(8, 60, 5000)
    texts = ["".join(r.choice("abc") for _ in range(r.randrange(30))) + passage + "".join(r.choice("abc") for _ in range(r.randrange(200))) for _ in range(1500)]
    frame = docs(spark, texts, parts=12)
    planned = suffix.join_borders(suffix.materialize(suffix.plan_blocks(suffix.index(frame, suffix.scratch(spark, "shards"))), "plan"))
    sizes = planned.where("block is not null and c1 is not null").groupBy("block").agg(F.sum(F.col("size") + suffix.LENGTH).alias("n"), F.countDistinct("owner").alias("k")).collect()
    assert max(x["n"] for x in sizes) <= bucket * 5 / 4 + 600 and (len(sizes) > 3) == cut
    assert (planned.where("c1 is null and block is not null").count() > 0) == cut
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix.remove_repeats(frame).collect()}
    assert [got[k] for k in range(len(texts))] == removed(texts)


def test_cover_meets_every_shift():
    assert {(a - b) % suffix.V for a in suffix.COVER for b in suffix.COVER} == set(range(suffix.V))
    assert suffix._SHIFT.max() <= 16


def test_repeats_of_nothing(spark):
    assert suffix.remove_repeats(docs(spark, [])).count() == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from chunkmill.llm.common import shared_dir

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, other: other), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)
    session.conf.get = lambda name, other: "hdfs://shared/folder/"
    assert shared_dir(session) == "hdfs://shared/folder"
