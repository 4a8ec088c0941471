"""Benchmark decontamination with an FM-index per training shard.

Benchmark items become windows of WINDOW consecutive words (shorter items: one window). Tasks prepare them in blocks of
bounded size in the shared folder, and a task that searches holds one block at a time, so neither the driver nor a worker
depends on the benchmark's size; the driver sees the blocks' paths alone. A shard is a few MB of whole documents. Its words are ids of the block's vocabulary; maximal runs
of known words that could hold a window form the indexed sequence, and all else can't take part in an occurrence.

Over that sequence: suffix array by prefix doubling, Burrows-Wheeler transform, a wavelet matrix for ranks, backward
search of all windows at once, and positions sampled every SAMPLE symbols and at run starts, reached by LF steps. The
occurrences of all blocks are merged into removal spans of words. Documents never leave their task: there is no shuffle.

Defined results: a null text or item has no words; items without words have no windows; repeated item rows count once by
item_id, a null item_id as "null"; repeated documents get equal results; other columns are ignored; an empty benchmark
hits nothing; texts of any length are held whole by a task. drop_contaminated() keeps rows with null columns and columns of
any name, and drops all rows of a document that is hit.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkmill.llm.common import arrow_limits, read_file, scratch, table, use_cache, write_file

WINDOW = 10
SHARD_BYTES, BLOCK_WORDS, SAMPLE = 6 << 20, 500_000, 16
# ASCII bytes that belong to words are 0-9 and a-z, after lower-casing; all other ASCII separates.
_WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_WORDS).split() if text else []


def windows(item: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    return [tuple(item[k : k + size]) for k in range(max(1, len(item) - size + 1))] if item else []


class Block:
    """Distinct windows over a vocabulary, and the items of each."""

    def __init__(self, items: list[tuple[str, list[tuple[bytes, ...]]]], size: int):
        owners: dict[tuple[bytes, ...], list[str]] = {}
        for item, own in items:
            for w in own:
                owners.setdefault(w, []).append(item)
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for window in owners for w in window}))}
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.windows = np.zeros((len(owners), size), np.int64)
        for k, w in enumerate(owners):
            self.windows[k, : len(w)] = [self.vocabulary[x] for x in w]
        self.items = [sorted(set(v)) for v in owners.values()]
        self.shortest = int(self.lengths.min()) if len(owners) else 0


def prepare(benchmark: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[str]:
    """Write the benchmark's windows into block files, in tasks; the files' paths. Each attempt of a task has names of its own."""
    folder = scratch(benchmark.sparkSession, "benchmark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, list[tuple[bytes, ...]]]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/block-{uuid.uuid4().hex}.pickle"
            write_file(path, pickle.dumps(Block(held, size)))
            return pa.RecordBatch.from_pydict({"path": [path]})

        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = windows(words(text), size)
                for k in range(0, len(own), block_words):
                    part = own[k : k + block_words]
                    held.append(("null" if item is None else item, part))
                    n += len(part)
                    if n >= block_words:
                        yield flush()
                        held, n = [], 0
        if held:
            yield flush()

    # Few large blocks rather than one for each input file: a shard is searched once for each block.
    letters = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    items = benchmark.select(F.col("item_id").cast("string"), "text").coalesce(max(1, letters // (8 * block_words)))
    return sorted(r["path"] for r in items.mapInArrow(run, "path string").collect())


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable")
    s = symbols[sa]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank = np.empty(n, np.int64)
    rank[sa] = start
    places, k = np.arange(n), 1
    while True:
        g = start[places]
        tied = np.concatenate([g[1:] == g[:-1], [False]])
        tied[1:] |= tied[:-1].copy()
        places = places[tied]
        if not len(places):
            return sa
        own = sa[places]
        after = np.where(own + k < n, rank[np.minimum(own + k, n - 1)] + 1, 0)
        key = start[places] * (n + 1) + after
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        sa[places] = own
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start[places] = places[np.flatnonzero(new)[np.cumsum(new) - 1]]
        rank[own] = start[places]
        k *= 2


class Bits:
    """A bit vector with constant-time ranks: 64-bit words and counts before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1)))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            one = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(one), int((~one).sum())))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before its i."""
        start = np.zeros_like(i)
        for bit, bits, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            r, s = bits.rank(i), bits.rank(start)
            i, start = np.where(one, zeros + r, i - r), np.where(one, zeros + s, start - s)
        return i - start


class FMIndex:
    """Over runs of symbols 1..top. Runs end with separators, the smallest symbols, all different in suffix order."""

    def __init__(self, runs: np.ndarray, is_end: np.ndarray, top: int, sample: int = SAMPLE):
        ends = int(is_end.sum())
        order = np.where(is_end, np.cumsum(is_end) - 1, runs + (ends - 1))
        sa = suffix_array(order)
        self.size = len(runs)
        text = np.where(is_end, 0, runs)
        self.bwt = text[sa - 1]
        self.tree = WaveletMatrix(self.bwt, top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        at = np.arange(self.size)
        starts = np.concatenate([[0], np.flatnonzero(is_end)[:-1] + 1])
        offset = at - starts[np.cumsum(np.concatenate([[False], is_end[:-1]]))]
        kept = offset[sa] % sample == 0
        self.rows, self.positions = np.flatnonzero(kept), sa[kept]

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.tree.rank(symbol, row)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first row, end row) of the patterns that occur."""
        which = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for back in range(int(lengths.max(initial=0))):
            on = lengths[which] > back
            if on.any():
                symbol = patterns[which[on], lengths[which[on]] - 1 - back]
                low[on], high[on] = self.step(symbol, low[on]), self.step(symbol, high[on])
            alive = high > low
            which, low, high = which[alive], low[alive], high[alive]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: LF steps to the nearest sampled position before."""
        out, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            at = np.minimum(np.searchsorted(self.rows, rows), len(self.rows) - 1)
            hit = self.rows[at] == rows
            out[todo[hit]] = self.positions[at[hit]] + steps
            todo, rows = todo[~hit], rows[~hit]
            rows = self.step(self.bwt[rows], rows)
            steps += 1
        return out


def occurrences(ids: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(window, position in ids) of all occurrences; 0 is no word of the block."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= block.shortest
    start, end = start[long], end[long]
    if not len(start) or not block.shortest:
        return none
    size = end - start + 1
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(first - start, size)
    is_end = np.zeros(len(at), bool)
    is_end[first + size - 1] = True
    index = FMIndex(np.where(is_end, 0, ids[np.minimum(at, len(ids) - 1)]), is_end, len(block.vocabulary))
    which, low, high = index.search(block.windows, block.lengths)
    n = high - low
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)
    return np.repeat(which, n), at[index.locate(rows)] if len(rows) else none[1]


_blocks: dict[str, Block] = {}


def forget() -> None:
    """Drop what this worker keeps; a function, so that tasks reach the module's own memory."""
    _blocks.clear()


def load(path: str) -> Block:
    if path not in _blocks:
        _blocks.clear()
        _blocks[path] = pickle.loads(read_file(path))
    return _blocks[path]


def search_shard(documents: list[str | None], blocks: list[str]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per document of a shard: number of words, merged spans of hit words, items with occurring windows."""
    known: defaultdict[bytes, int] = defaultdict(count(1).__next__)  # the shard's words, numbered; each text is cut into words once, whatever the number of blocks
    own = [np.fromiter(map(known.__getitem__, words(t)), np.int64) for t in documents]
    n = np.array([len(x) for x in own], np.int64)
    first = np.cumsum(n + 1) - (n + 1)
    cover = np.zeros(int((n + 1).sum()) + 1, np.int64)
    places = np.zeros(len(cover) - 1, np.int64)
    for k, x in enumerate(own):
        places[first[k] : first[k] + n[k]] = x
    found: list[set[str]] = [set() for _ in documents]
    for path in blocks:
        block = load(path)
        get = block.vocabulary.get
        which, at = occurrences(np.array([0, *(get(w, 0) for w in known)], np.int64)[places], block)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + block.lengths[which], -1)
        doc = np.searchsorted(first, at, side="right") - 1
        for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist() if len(at) else ():
            found[d].update(block.items[w])
    edge = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8), [0]]))
    spans: list[list[tuple[int, int]]] = [[] for _ in documents]
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        d = int(np.searchsorted(first, a, side="right")) - 1
        spans[d].append((a - int(first[d]), b - int(first[d])))
    return [(int(k), s, sorted(f)) for k, s, f in zip(n, spans, found, strict=True)]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with n_words, spans ("start:end" of hit words, comma-joined), n_hit, n_items, items_sha256 and contaminated, which replace columns of these names."""
    spark = docs.sparkSession
    arrow_limits(spark)
    blocks = prepare(benchmark, size)
    added = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.string())])

    docs = docs.drop(*added.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = iter(search_shard([t for b in held for t in b.column("text").to_pylist()], blocks))
            for b in held:
                rows = [next(got) for _ in range(b.num_rows)]
                hits = [sum(y - x for x, y in s) for _, s, _ in rows]
                columns = [[r[0] for r in rows], hits, [len(r[2]) for r in rows], [hashlib.sha256(",".join(r[2]).encode()).hexdigest() for r in rows], [h > 0 for h in hits], [",".join(f"{x}:{y}" for x, y in r[1]) for r in rows]]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, f.type) for c, f in zip(columns, added, strict=True))], names=[*b.schema.names, *added.names])

        use_cache("benchmark", forget)
        held, size_held = [], 0
        for batch in batches:
            held.append(batch)
            size_held += batch.column("text").nbytes
            if size_held >= shard_bytes:
                yield from flush(held)
                held, size_held = [], 0
        if held:
            yield from flush(held)

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string")


def remove_spans(text: str, spans: str) -> str:
    """The text without the words of the spans (as contamination() gives them), and without what lies between them."""
    data = text.encode("utf-8", "surrogatepass")
    plain = data.lower().translate(_WORDS)
    edge = np.diff(np.concatenate([[0], (np.frombuffer(plain, np.uint8) != 32).astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for span in filter(None, spans.split(",")):
        a, b = map(int, span.split(":"))
        out.append(data[at : start[a]])
        at = end[b - 1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without an occurrence, with their own columns."""
    packed = docs.select("text", F.struct(F.lit(0).alias("none"), *[c for c in docs.columns if c != "text"]).alias("row"))
    out = contamination(packed, benchmark).where(~F.col("contaminated"))
    return out.select(*["text" if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
o AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM o) GROUP BY doc_id),
m AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) - 1 AS p FROM o)),
g AS (SELECT doc_id, min(p) AS a, max(p) + 1 AS z FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM m) GROUP BY doc_id, k),
s AS (SELECT doc_id, string_agg(concat(a, ':', z), ',' ORDER BY a) AS spans FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)
"""
