"""Near-duplicates: banded MinHash, sequential Bayesian verification, exact confirmation.

1. Each text gets the set of its 5-word shingles, a signature of HASHES minima and a place in a text store. Texts with
   equal sets form a class, which its least doc_id stands for; all else works on classes.
2. Signatures are cut into BANDS bands; a band's value is a bucket. At similarity 0.75 a pair shares no bucket with
   probability 5e-6.
3. Each class is first compared with one leader (the least class) of its buckets, not with all others. Signatures are
   compared batch by batch; with m of n minima equal and a uniform prior, the similarity's posterior is Beta(m + 1,
   n - m + 1), and the pair is dropped once the probability of reaching the threshold falls below MISS.
4. Survivors are confirmed on full sets and joined into components. Only buckets that still hold several components are
   looked at again, and only pairs across components: a bucket's rows outside its largest component meet all its rows
   in blocks of bounded size, in the first band that a pair shares. There a pair takes the sequential test and, if it
   survives, is confirmed at once, so only links between components leave a task, one for each row and foreign
   component. Groups of copies never expand into all pairs. Blocks are bounded by rows and by bytes of text (a single text
   may be longer).
5. A bucket with very many rows outside its largest component (texts that share a long passage and little else) is not
   compared row by row. Its rows meet by prefixes of their full sets instead, without signatures: with shingles ordered from
   rare to frequent, two sets that link have one in common among the first n - ceil(0.75 n) + 1 of each, so the passage
   that filled the bucket is left out unless a text is little else. A prefix's hash is a bucket; what can still reach the
   threshold by size and position is confirmed on full sets, again first with one leader of each bucket, then across
   components in blocks. No link is lost here, and nothing is compared that shares common shingles alone.

The rows of an open bucket are salted by its number of rows; other joins on a leader, a bucket, a hash or a set may meet hot keys, but their rows are a
few numbers, and adaptive execution splits them.
Empty sets, which all are one key, take part in no join.

Defined results: a null or word-free text has an empty set, n_shingles 0, and is its own component; rows with a null
doc_id are kept and have a null component; rows that repeat a doc_id are one node; other columns are ignored; an empty
table gives no rows. keep_one() keeps the rows of kept doc_ids: rows equal in doc_id and text stay once, rows with the same
doc_id and different texts all stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkmill.llm.common import arrow_limits, materialize, partitions, scratch, table, temporaries, use_cache
from chunkmill.llm.components import components
from chunkmill.llm.docstore import ShardWriter, with_texts

SHINGLE, SIMILARITY = 5, 0.75
HASHES, BANDS = 128, 32
#: Minima per step of the sequential test, and the probability of dropping a pair that reaches the threshold.
STEP, MISS = 32, 1e-5
#: Rows and bytes of text of a block of a bucket, partners of a leader in one task, words that a worker remembers.
BLOCK_ROWS, BLOCK_BYTES, CHUNK, CACHE_WORDS = 512, 8 << 20, 128, 250_000
#: Blocks of asking rows, as counted in rows, beyond which a bucket is split by prefixes, and levels of splitting: 1 leaves buckets whole.
MANY_BLOCKS, DEPTH = 8, 2
#: A block of prefixes holds numbers, no texts: so many times the rows of another.
WIDER = 16
#: Rows of a bucket that meet what is known of it in one part.
SALT_ROWS = 2048
#: Counters that order shingles by frequency; they decide what is looked at, never what is found.
SLOTS = 1 << 16
_rng = np.random.default_rng(7)
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_known = _Words()


def forget() -> None:
    """Drop what this worker keeps; a function, so that tasks reach the module's own memory."""
    _known.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; words are split at U+0020 and U+0009 to U+000D, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_known) > CACHE_WORDS:
        _known.clear()
    w = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k]
    return np.unique(_mix(h))


def signature(hashes: np.ndarray) -> bytes:
    """HASHES minima, two bytes of each."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        out = np.minimum(out, (x[k : k + 4096] * _A + _B).min(1))
    return ((out * np.uint32(2654435761)) >> np.uint32(16)).astype("<u2").tobytes()


@cache
def least_matches(n: int, similarity: float = SIMILARITY, miss: float = MISS) -> int:
    """Fewest equal minima among n that keep P(similarity reached) >= miss; by P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)."""
    total = 0.0
    for m in range(n + 1):
        total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(similarity) + (n + 1 - m) * math.log(1 - similarity))
        if total >= miss:
            return m
    return n


def likely(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequential test of row pairs: indices of the survivors and their equal minima."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k in range(0, HASHES, STEP):
        if not len(alive):
            break
        equal = equal + (a[alive, k : k + STEP] == b[alive, k : k + STEP]).sum(1)
        keep = equal >= least_matches(k + STEP)
        alive, equal = alive[keep], equal[keep]
    return alive, equal


def is_link(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= round(100 * SIMILARITY) * (len(a) + len(b) - both)


def describe(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_shingles, set_id, sig, size (bytes of text), shard, row; the texts go to the store in folder."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("sig", pa.binary()), ("size", pa.int64()), ("shard", pa.string()), ("row", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        use_cache("words", forget)
        writer = ShardWriter(folder)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = shingles(text or b"")
                some = len(own) and doc is not None
                rows.append((doc, len(own), xxhash.xxh3_128_digest(own.tobytes()) if some else None, signature(own) if some else None, len(text or b""), *(writer.add(text) if some else (None, None))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        writer.close()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, sig binary, size long, shard string, row long")


def _tested(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that survive the sequential test."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            alive, _ = likely(x, y)
            yield batch.select(["a", "b"]).take(pa.array(alive)).cast(schema)

    sig = lambda c: classes.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}"))
    return pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """The pairs (a, b) that link by their full sets. A leader a meets its partners in chunks of about CHUNK."""
    spark = pairs.sparkSession
    pairs = materialize(pairs, "pairs")
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    split = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.floor(F.col("n") / CHUNK) + 1).alias("chunk"))
    rows = split.select("a", "chunk", F.col("b").alias("id")).unionByName(split.select("a", "chunk", F.col("a").alias("id")).distinct())
    rows = rows.join(classes.select(F.col("rep").alias("id"), "shard", "row"), "id")
    schema = pa.schema([("a", pa.int64()), ("chunk", pa.int64()), ("id", pa.int64()), ("text", pa.binary())])
    read = with_texts(rows, folder, lambda own, got: ({"a": r["a"], "chunk": r["chunk"], "id": r["id"], "text": t} for r, t in zip(own, got, strict=True)), schema, "a long, chunk long, id long, text binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_cache("words", forget)
        key, lead = None, None
        for batch in batches:
            out = []
            for a, chunk, i, text in zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "id", "text")), strict=True):
                own = shingles(text)
                if i == a:
                    key, lead = (a, chunk), own
                elif key == (a, chunk) and is_link(lead, own):
                    out.append((a, i))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    dealt = read.repartition(partitions(spark), "a", "chunk").sortWithinPartitions("a", "chunk", (F.col("id") != F.col("a")), "id")
    return dealt.mapInArrow(run, "a long, b long")


def links_across(reps: np.ndarray, comps: np.ndarray, asks: np.ndarray, answers: np.ndarray, sigs: np.ndarray, texts: list[bytes], band: int, depth: int = 1) -> Iterator[tuple[int, int]]:
    """Links between an asking row and answering rows of other components, one for each component; of pairs that share depth bands up to this one."""
    width = HASHES // BANDS
    sets: dict[int, np.ndarray] = {}

    def own(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = shingles(texts[k])
        return sets[k]

    data, parts = np.flatnonzero(answers), comps[answers]
    for k in np.flatnonzero(asks).tolist():
        other = data[(parts != comps[k]) & (~asks[data] | (reps[data] < reps[k]) | (not answers[k]))]
        upto = band + 1
        shared = (sigs[other, : upto * width].reshape(len(other), upto, width) == sigs[k, : upto * width].reshape(upto, width)).all(2).sum(1)
        other = other[shared == depth]
        alive, equal = likely(np.broadcast_to(sigs[k], (len(other), HASHES)), sigs[other])
        other = other[alive][np.argsort(-equal, kind="stable")]
        done: set[int] = set()
        while len(other):
            now, other = other[:256], other[256:]
            found = [own(j) for j in now.tolist()]
            size = np.array([len(f) for f in found])
            every, mine = np.concatenate(found), own(k)
            inside = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
            both = np.add.reduceat(inside.astype(np.int64), np.cumsum(size) - size)
            for j in now[100 * both >= round(100 * SIMILARITY) * (size + len(mine) - both)].tolist():
                if int(comps[j]) not in done:
                    done.add(int(comps[j]))
                    yield int(reps[k]), int(reps[j])
            if done:
                other = other[~np.isin(comps[other], list(done))]


def _across(rows: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """Links (a, b) across components: rows (key, band, depth, q, d, asks, answers, rep, component) get signature and text and are dealt by (key, q, d)."""
    fields = {"key": pa.int64(), "band": pa.int32(), "depth": pa.int32(), "q": pa.int64(), "d": pa.int64(), "rep": pa.int64(), "component": pa.int64(), "asks": pa.bool_(), "answers": pa.bool_(), "sig": pa.binary(), "text": pa.binary()}
    ddl = "key long, band int, depth int, q long, d long, rep long, component long, asks boolean, answers boolean, sig binary, text binary"
    wanted = rows.join(classes.select("rep", "sig", "shard", "row"), "rep")
    dealt = with_texts(wanted, folder, lambda own, got: ({**{n: r[n] for n in fields if n != "text"}, "text": t} for r, t in zip(own, got, strict=True)), pa.schema(list(fields.items())), ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_cache("words", forget)
        held: list[tuple] = []
        key = None

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                reps, comps, asks, answers, sigs, texts = zip(*held, strict=True)
                found = list(links_across(np.array(reps), np.array(comps), np.array(asks), np.array(answers), np.frombuffer(b"".join(sigs), "<u2").reshape(-1, HASHES), list(texts), *key[3:]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "q", "d", "band", "depth", "rep", "component", "asks", "answers", "sig", "text"))
            for *own, rep, comp, asks, answers, sig, text in zip(*columns, strict=True):
                if own != key:
                    yield from flush()
                    held, key = [], own
                held.append((rep, comp, asks, answers, sig, text))
        yield from flush()

    return dealt.repartition(partitions(rows.sparkSession), "key", "q", "d").sortWithinPartitions("key", "q", "d", "rep").mapInArrow(run, "a long, b long")


def band_key(*first) -> Callable[[Column], Column]:
    """The bucket of a band of sig, as a function of the band's number."""
    width = 2 * HASHES // BANDS
    return lambda k: F.xxhash64(*first, k, F.substring(F.col("sig"), k * width + 1, F.lit(width)))


def _blocks(rows: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """Rows of open buckets, dealt into blocks: those outside the bucket's leading component ask, all answer."""
    rows = rows.withColumn("asking", F.col("component") != F.col("lead"))
    number = F.lit(0).cast("long")
    mine_d, mine_q = F.pmod(F.xxhash64("rep"), F.col("nd")), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("nq"))
    all_of = lambda n: F.sequence(number, F.col(n) - 1)
    names = [*own, "q", "d"]
    answering = rows.select("*", F.explode(all_of("nq")).alias("q"), mine_d.alias("d")).select(*names, F.lit(False).alias("asks"), F.lit(True).alias("answers"))
    asking = rows.where("asking").select("*", mine_q.alias("q"), F.explode(all_of("nd")).alias("d")).select(*names, F.lit(True).alias("asks"), F.lit(False).alias("answers"))
    return answering.unionByName(asking).groupBy(*names).agg(F.max("asks").alias("asks"), F.max("answers").alias("answers"))


def _open_buckets(placed: DataFrame, wider: int = 1) -> DataFrame:
    """key, rows, lead, crowded, nq, nd of the buckets that hold several components: the largest one, and into how many blocks rows are dealt."""
    blocks_of = lambda n, size: F.ceil(F.greatest(n / (wider * BLOCK_ROWS), size / BLOCK_BYTES, F.lit(0.0)))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("rows").alias("rows"))
    per = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max("rows").alias("rows"), F.max(F.struct("n", "component", "size")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    asking = F.col("n") - F.col("top.n")
    return materialize(per.select("key", "rows", F.col("top.component").alias("lead"), (asking > MANY_BLOCKS * BLOCK_ROWS).alias("crowded"), blocks_of(asking, F.col("size") - F.col("top.size")).alias("nq"), blocks_of(F.col("n"), F.col("size")).alias("nd")), "open")


def _told(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Rows with what is known of their buckets; salted, as a bucket may hold most rows."""
    salts = F.ceil(F.col("rows") / SALT_ROWS).cast("int")  # "rows" is the same in all rows of a bucket
    salted = per.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("rows")
    return rows.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(2)), salts).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def _open_rows(placed: DataFrame, per: DataFrame, held: DataFrame | None) -> DataFrame:
    """Rows of the open buckets in blocks, at depth 1; those of crowded ones are at depth 2 instead, in the buckets of their prefixes: held."""
    rows = _told(placed, per).withColumn("depth", F.lit(1))
    own = ("key", "band", "depth", "rep", "component")
    if held is None:
        return _blocks(rows, own)
    return _blocks(rows.where("not crowded"), own).unionByName(held.withColumn("depth", F.lit(2)), allowMissingColumns=True)


def prefix(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest hashes of a set, rare ones first: any set that links with it has one of them in its own prefix."""
    least = -(-round(100 * SIMILARITY) * len(hashes) // 100)
    order = np.lexsort((hashes, counts[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]))
    return hashes[order[: len(hashes) - least + 1]]


def able(comps: np.ndarray, asks: np.ndarray, answers: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Asking rows and answering rows of other components that can link, if a hash at these places of their sets is the first that they share."""
    data, share = np.flatnonzero(answers), round(100 * SIMILARITY)
    for k in np.flatnonzero(asks).tolist():
        most = np.minimum(sizes[data] - places[data], sizes[k] - places[k])
        yield k, data[(comps[data] != comps[k]) & ((100 + share) * most >= share * (sizes[data] + sizes[k]))]


def _prefixes(reps: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """key, rep, n, place, rows, first of the prefixes' hashes that several sets share and that can be the first shared by sets that link.

    The smaller of two such sets, of n hashes, has it within its first n / 7: of what follows it must share 6 / 7 of n at least.
    """
    rows = materialize(reps.join(classes.select("rep", "shard", "row"), "rep"), "crowded")
    schema = pa.schema([("rep", pa.int64()), ("text", pa.binary())])
    read = with_texts(rows, folder, lambda own, got: ({"rep": r["rep"], "text": t} for r, t in zip(own, got, strict=True)), schema, "rep long, text binary")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_cache("words", forget)
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(seen, (shingles(text) & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        slots = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(seen[slots])], names=["slot", "n"])

    counts = np.zeros(SLOTS, np.int64)
    for r in read.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # a row of each counter
        counts[r["slot"]] = r["n"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_cache("words", forget)
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            firsts = [prefix(own, counts) for own in sets]
            if firsts:
                each = np.array([len(f) for f in firsts])
                of = np.repeat(np.arange(len(firsts)), each)
                places = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
                size = np.array([len(own) for own in sets])[of]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64)), batch.column("rep").take(pa.array(of)), pa.array(size), pa.array(places)], names=["key", "rep", "n", "place"])

    every = materialize(read.mapInArrow(cut, "key long, rep long, n long, place long"), "prefixes")
    share = round(100 * SIMILARITY)
    early = (100 + share) * (F.col("n") - F.col("place")) >= 2 * share * F.col("n")
    mine = F.when(early, F.col("n"))
    shared = every.groupBy("key").agg(F.count("*").alias("rows"), F.min(F.when(early, F.struct("rep", "n", "place"))).alias("first"), F.min(mine).alias("least"), F.max(mine).alias("most")).where("rows > 1 and first is not null")
    wanted = early | ((F.col("n") >= F.col("least")) & (share * F.col("n") <= 100 * F.col("most")))
    return materialize(every.join(shared, "key").where(wanted).drop("least", "most"), "prefixes")


def _firsts(held: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) across components that can link: of each hash the least set that has it early, and all others."""
    share = round(100 * SIMILARITY)
    most = F.least(F.col("n") - F.col("place"), F.col("first.n") - F.col("first.place"))
    able = (100 + share) * most >= share * (F.col("n") + F.col("first.n"))
    pairs = held.where(able & (F.col("rep") != F.col("first.rep"))).select(F.least("rep", "first.rep").alias("a"), F.greatest("rep", "first.rep").alias("b")).distinct()
    part = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    return pairs.join(part("a"), "a", "left").join(part("b"), "b", "left").where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")


def _meeting(held: DataFrame) -> DataFrame:
    """Pairs (a, b) across components that can link, of all rows of the prefixes' buckets; they meet in blocks."""
    held = held.select("key", "rep", "component", "n", "place", "rows")
    per = _open_buckets(held.withColumn("size", F.lit(0).cast("long")), WIDER)
    blocks = _blocks(_told(held, per), ("key", "rep", "component", "n", "place"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        key = None

        def flush() -> Iterator[pa.RecordBatch]:
            if len(block) > 1:
                reps, *rest = (np.array(c) for c in zip(*block, strict=True))
                for k, other in able(*rest):
                    if len(other):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(reps[other], reps[k])), pa.array(np.maximum(reps[other], reps[k]))], names=["a", "b"])

        for batch in batches:
            for *own, rep, comp, asks, answers, n, place in zip(*(batch.column(c).to_pylist() for c in ("key", "q", "d", "rep", "component", "asks", "answers", "n", "place")), strict=True):
                if own != key:
                    yield from flush()
                    block, key = [], own
                block.append((rep, comp, asks, answers, n, place))
        yield from flush()

    dealt = blocks.repartition(partitions(held.sparkSession), "key", "q", "d").sortWithinPartitions("key", "q", "d", "rep")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per document."""
    spark = docs.sparkSession
    arrow_limits(spark)
    with temporaries(spark):  # the result needs signatures, classes and labels alone
        folder = scratch(spark, "texts")
        every = materialize(describe(docs, folder), "signatures", keep=True)
        first = F.first(F.struct("sig", "size", "shard", "row"))
        classes = every.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), first.alias("x"))
        classes = materialize(classes.select("set_id", "rep", "x.sig", "x.size", "x.shard", "x.row"), "classes", keep=True)

        buckets = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band_key())
        rows = classes.select("rep", "size", F.posexplode(buckets).alias("band", "key"))
        shared = rows.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("rows")).where("lead <> last").select("key", "lead", "rows")
        members = materialize(rows.join(shared, "key"), "buckets")

        leads = members.where("rep <> lead").groupBy(F.col("rep").alias("b")).agg(F.min("lead").alias("a")).select("a", "b")
        links = materialize(confirm(_tested(leads, classes), classes, folder), "links")
        labels = materialize(components(links), "labels", keep=True)
        labelled = lambda rows, *own: rows.join(labels, rows["rep"] == labels["node"], "left").select("key", "rep", "rows", *own, F.coalesce("component", "rep").alias("component"))
        placed = labelled(members, "band", "size")
        opened = _open_buckets(placed)
        crowded = opened.where("crowded").select("key")
        held = None
        if DEPTH > 1 and not crowded.isEmpty():
            held = _prefixes(members.join(crowded, "key").select("rep").distinct(), classes, folder)
            links = links.unionByName(materialize(confirm(_firsts(held, labels), classes, folder), "links"))
            labels = materialize(components(links), "labels", keep=True)
            placed, held = labelled(members, "band", "size"), labelled(held, "n", "place")
            opened = _open_buckets(placed)  # what is crowded now was so before
        rows = _open_rows(placed, opened, held)
        more = _across(rows.where("depth = 1"), classes, folder)
        if held is not None:
            more = more.unionByName(confirm(_meeting(rows.where("depth > 1")), classes, folder))
        more = materialize(more, "links")
        if not more.isEmpty():
            labels = materialize(components(links.unionByName(more)), "labels", keep=True)
    reps = classes.select("set_id", "rep").join(labels, classes["rep"] == labels["node"], "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    rows = every.select("doc_id", "n_shingles", "set_id")
    out = rows.where("set_id is not null").join(reps, "set_id").unionByName(rows.where("set_id is null").withColumn("component", F.lit(None).cast("long")))
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, with its own columns: those whose doc_id is the component's; rows equal in doc_id and text once."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    found = docs.join(kept.where("__kept_id is not null"), F.col("doc_id") == F.col("__kept_id"), "left_semi")
    # rows are compared by their texts only where a doc_id comes more than once
    again = docs.groupBy(F.col("doc_id").alias("__again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and __again is not null").select("__again")
    on = F.col("doc_id") == F.col("__again")
    return found.join(again, on, "left_anti").unionByName(found.join(again, on, "left_semi").dropDuplicates(["doc_id", "text"])).unionByName(docs.where("doc_id is null"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(generate_series(1, greatest(1, len(w) - 4)), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM w WHERE len(w) > 0),
c AS (SELECT min(doc_id) AS rep, s, list(doc_id) AS ids FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s),
x AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * k >= 75 * (na + nb - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS rep, min(b) AS component FROM r GROUP BY a),
o AS (SELECT unnest(ids) AS doc_id, component FROM c JOIN m USING (rep))
SELECT w.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles, coalesce(o.component, w.doc_id) AS component_id, coalesce(o.component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN o USING (doc_id)
"""
