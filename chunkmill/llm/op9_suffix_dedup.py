"""Removal of repeated byte strings with blockwise, difference-cover suffix sorting.

Every window of LENGTH bytes has an owner: the least of its K-byte strings by hash, the leftmost of equals. Equal windows
have equal owners at equal offsets, so windows need only meet those of the same owner string: a suffix bucket. A run of
windows with one owner is a stretch of text around it, about 280 bytes; its content is named by a 128-bit BLAKE2 digest.

1. Texts are written to shard files with their stretches. A shard reports each distinct content once, with a count:
   groups of copies shrink before any shuffle.
2. Contents are range-partitioned in the order (owner, content), so an owner with very many contents spans as many
   partitions as it fills. One pass over each partition finds contents that occur twice, which are repeated as a whole,
   and lays the contents of owners that have several into blocks: a bucket lies in one block unless it has more than
   BUCKET_BYTES of text. The blocks at the borders of partitions are joined where a bucket goes on and both fit.
3. Blocks get their texts, once for each content, and each block's suffixes are sorted. Stretches are laid out with owners
   at multiples of V, so the suffixes of a bucket at one offset lie in one residue class, and a fixed shift takes all of
   them to positions of the difference cover. Suffixes are ordered by their first 16 bytes and then by the precomputed
   rank of their cover sample; samples are ranked by prefix doubling in steps of V. Neighbours are compared on all LENGTH
   bytes.
4. Of a bucket that is cut, each of its blocks also reports each distinct window once, by digest, and windows that several
   blocks report are repeated. So a bucket of any size is sorted block by block, in bounded memory and in as many tasks as
   it has blocks.
5. Results return to the shards, which cover, cut and digest their texts.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; repeated rows repeat each other's strings
and are removed like all copies; matches never cross documents; other columns are ignored; an empty table gives no rows.
Strings in one block are compared byte by byte, contents and windows of different blocks by their digests.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkmill.llm.common import arrow_limits, filesystem, materialize, partitions, scratch, table, use_cache

LENGTH, K = 200, 40
SPAN = LENGTH - K + 1
#: A perfect difference set modulo 31: any two residues meet in it after one common shift.
V, COVER = 31, (1, 5, 11, 24, 25, 27)
SHARD_BYTES, PIECE_BYTES = 8 << 20, 512 << 10
#: Text of a block, and of a bucket that is not cut.
BLOCK_BYTES, BUCKET_BYTES = 1 << 20, 4 << 20
_rng = np.random.default_rng(99)
_T = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SHIFT = np.array([next(s for s in range(V) if (s - d) % V in COVER) for d in range(SPAN)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def forget() -> None:
    """Drop what this worker keeps; a function, so that tasks reach the module's own memory."""
    _tables.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def stretches(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Owner position, first and last window start and owner hash of each run of windows; valid marks window starts."""
    size = -(-len(data) // (1 << 18)) << 18
    if size not in _tables:
        _tables.clear()
        _tables[size] = _powers(_BASE, size + 1), _powers(_INVERSE, size + 1)
    up, down = _tables[size]
    prefix = np.empty(len(data) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_T[data] * up[: len(data)], out=prefix[1:])
    n = len(data) - K + 1
    gram = _mix((prefix[K:] - prefix[:n]) * down[:n])
    low = gram & ~np.uint64(0xFFFFFF) | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if SPAN > width:
        low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
    owner = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    at = np.flatnonzero(valid[: len(owner)])
    own = owner[at]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    own, lo, hi = own[first], at[first], at[last]
    return own, lo, hi, gram[own].view(np.int64)


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of data[start:end], as rows of two numbers."""
    view, digest = memoryview(data), hashlib.blake2b
    found = [digest(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def text_stretches(texts: list[bytes]) -> list[np.ndarray]:
    """Per text an array of rows (first window, last window, owner position, owner hash, content digest in two numbers); short texts share a pass, long ones are cut with overlap."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        joined = b"".join(p for _, _, p in held)
        data = np.frombuffer(joined, np.uint8)
        size = np.array([len(p) for _, _, p in held])
        start = np.cumsum(size) - size
        valid = np.ones(len(data), bool)
        for s, n in zip(start.tolist(), size.tolist(), strict=True):
            valid[s + n - LENGTH + 1 : s + n] = False
        own, lo, hi, gram = stretches(data, valid)
        content = digests(joined, lo, hi + LENGTH)
        content = np.stack([content[:, 0] ^ (own - lo), content[:, 1]], 1)
        part = np.searchsorted(start, lo, side="right") - 1
        cut = np.searchsorted(part, np.arange(len(held) + 1))
        for k, (doc, offset, _) in enumerate(held):
            r = slice(cut[k], cut[k + 1])
            move = offset - start[k]
            out[doc].append(np.column_stack([lo[r] + move, hi[r] + move, own[r] + move, gram[r], content[r]]))
        held.clear()

    total = 0
    for doc, text in enumerate(texts):
        for at in range(0, max(0, len(text) - LENGTH + 1), PIECE_BYTES):
            piece = text[at : at + PIECE_BYTES + LENGTH - 1]
            held.append((doc, at, piece))
            total += len(piece)
            if total >= PIECE_BYTES:
                flush()
                total = 0
    if held:
        flush()
    return [np.concatenate(x) if x else np.zeros((0, 6), np.int64) for x in out]


def _path(base: str, shard: int) -> str:
    return f"{base}/{shard}.parquet"


_STRETCH = "owner long, c1 long, c2 long, n long, shard long, row long, lo long, size long, lead long"
_LONGS = [x.split()[0] for x in _STRETCH.split(", ")]


def index(docs: DataFrame, folder: str) -> DataFrame:
    """Write the shards; returns owner, content (c1, c2), n, shard, row, lo, size, lead for each distinct content of a shard, and a row with only shard for each shard."""
    schema = pa.schema([(c, pa.int64()) for c in _LONGS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_cache("powers", forget)
        files, base = filesystem(folder)
        files.create_dir(base, recursive=True)
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            shard, found = uuid.uuid4().int >> 65, text_stretches(held)
            with files.open_output_stream(_path(base, shard), compression=None) as out:
                columns = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(held, pa.large_binary()), "stretches": pa.array([x[:, [0, 1, 4, 5]].tobytes() for x in found], pa.large_binary())}
                pq.write_table(pa.table(columns), out, compression="zstd", use_dictionary=False, write_statistics=False)
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            every = np.concatenate(found)
            order = np.lexsort((every[:, 5], every[:, 4]))
            every, row = every[order], row[order]
            new = np.concatenate([[True], (every[1:, 4:] != every[:-1, 4:]).any(1)]) if len(every) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            n = np.diff(np.concatenate([first, [len(every)]]))
            x = every[first]
            columns = [x[:, 3], x[:, 4], x[:, 5], n, np.full(len(x), shard), row[first], x[:, 0], x[:, 1] - x[:, 0], x[:, 2] - x[:, 0]]
            for k in range(0, len(x), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 20_000], pa.int64()) for c in columns], schema=schema)
            yield pa.RecordBatch.from_pylist([{"shard": shard}], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                ids.append(doc)
                held.append(text or b"")
                size += len(held[-1])
                if size >= SHARD_BYTES:
                    yield from flush()
                    ids, held, size = [], [], 0
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _STRETCH)


def plan_blocks(found: DataFrame) -> DataFrame:
    """Rows of found that matter, with whole (the content occurs twice) and block (null but for one row of each content whose owner has others); and rows with only owner and block for buckets that are cut.

    Partitions are ranges of (owner, c1, c2). What lies in neighbouring partitions isn't known, so the first and the last
    content of a partition count as contents whose owner has others.
    """
    least, most = BLOCK_BYTES, BUCKET_BYTES
    names = [*_LONGS, "whole", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        before: int | None = None  # owner of the content before
        run_owner, run_start, number, total = None, 0, 0, 0  # of the last bucket that was laid out

        def settle(rows: np.ndarray, after: int | None) -> Iterator[pa.RecordBatch]:
            """rows: whole contents, in order; after: the owner that follows, None at the end."""
            nonlocal before, run_owner, run_start, number, total
            first = np.flatnonzero(np.concatenate([[True], (rows[1:, 1:3] != rows[:-1, 1:3]).any(1)]))
            owner = rows[first, 0]
            whole = np.add.reduceat(rows[:, 3], first) > 1
            same = owner[1:] == owner[:-1]
            several = np.concatenate([[before is None or before == owner[0]], same]) | np.concatenate([same, [after is None or after == owner[-1]]])
            before = int(owner[-1])
            of = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(rows)]])))
            place = np.full(len(rows), -1, np.int64)
            laid = np.flatnonzero(several)
            if len(laid):
                size, own = rows[first[laid], 7] + LENGTH, owner[laid]
                at = total + np.cumsum(size) - size
                opens = np.flatnonzero(np.concatenate([[own[0] != run_owner], own[1:] != own[:-1]]))
                start = np.full(len(laid), run_start, np.int64)
                start[opens] = at[opens]
                start = np.maximum.accumulate(start)
                block = start // least + (at - start) // most
                cut = np.flatnonzero((np.concatenate([[number], block[:-1]]) != block) & np.concatenate([[own[0] == run_owner], own[1:] == own[:-1]]))
                if len(cut):
                    both = np.concatenate([np.concatenate([[number], block[:-1]])[cut], block[cut]]) | part
                    none = pa.nulls(len(both), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(own[cut], 2)), *[none] * (len(_LONGS) - 1), pa.nulls(len(both), pa.bool_()), pa.array(both)], names=names)
                run_owner, run_start, number, total = int(own[-1]), int(start[-1]), int(block[-1]), total + int(size.sum())
                place[first[laid]] = block | part
            keep = np.flatnonzero(whole[of] | (place >= 0))
            columns = [pa.array(rows[keep, k]) for k in range(len(_LONGS))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(whole[of[keep]]), pa.array(place[keep], mask=place[keep] < 0)], names=names)

        held = np.zeros((0, len(_LONGS)), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.column_stack([batch.column(c).to_numpy() for c in _LONGS])])
            last = np.flatnonzero((held[1:, 1:3] != held[:-1, 1:3]).any(1))
            if len(last):  # the last content may go on
                cut = int(last[-1]) + 1
                yield from settle(held[:cut], int(held[cut, 0]))
                held = held[cut:]
        if len(held):
            yield from settle(held, None)

    key = ["owner", "c1", "c2"]
    dealt = found.where("owner is not null").repartitionByRange(partitions(found.sparkSession), *key).sortWithinPartitions(*key, "shard")
    return dealt.mapInArrow(run, f"{_STRETCH}, whole boolean, block long")


def join_borders(planned: DataFrame) -> DataFrame:
    """planned with the blocks at partition borders joined where a bucket goes on, or marked as cut where they don't fit together.

    The driver sees the first and the last block of each partition alone.
    """
    spark = planned.sparkSession
    blocks = planned.where("block is not null and c1 is not null").groupBy("block").agg(F.sum(F.col("size") + LENGTH).alias("bytes"), F.min("owner").alias("low"), F.max("owner").alias("high"))
    one = F.struct("block", "bytes", "low", "high")
    edges = blocks.groupBy(F.shiftright("block", 32).alias("part")).agg(F.min_by(one, "block").alias("first"), F.max_by(one, "block").alias("last")).collect()
    moved: list[tuple[int, int]] = []
    marks: list[tuple[int, int]] = []
    block, size, owner = None, 0, None  # the last block so far
    for edge in sorted(edges, key=lambda e: e["part"]):
        first, last = edge["first"], edge["last"]
        target = first["block"]
        if block is not None and first["low"] == owner:
            if size + first["bytes"] <= BLOCK_BYTES + BUCKET_BYTES:
                target = block
                moved.append((first["block"], target))
            else:
                marks += [(owner, block), (owner, first["block"])]
        alone = first["block"] == last["block"]
        block, owner = (target if alone else last["block"]), last["high"]
        size = (size if target != first["block"] else 0) + first["bytes"] if alone else last["bytes"]
    to = spark.createDataFrame(moved, "block long, target long")
    out = planned.join(F.broadcast(to), "block", "left").withColumn("block", F.coalesce("target", "block")).select(*planned.columns)
    marked = spark.createDataFrame(marks, "owner long, block long")
    return out.unionByName(marked, allowMissingColumns=True)


def repeated_windows(texts: list[bytes], leads: np.ndarray, counts: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the windows of all stretches (count windows from the first byte on, owner at lead; stretches of a bucket share an owner). Tells for each window whether it equals another, and whether it is the first of its equals."""
    pad = -leads % V
    room = pad + np.array([len(t) for t in texts]) + LENGTH
    start = np.cumsum(room + -room % V) - (room + -room % V)
    total = int(start[-1] + room[-1] + V)
    data = np.zeros(total + 16, np.uint8)
    base = start + pad
    for s, t in zip(base.tolist(), texts, strict=True):
        data[s : s + len(t)] = np.frombuffer(t, np.uint8)
    eight = np.zeros(total, np.uint64)
    for k in range(8):
        eight = eight << np.uint64(8) | data[k : k + total]
    # Cover samples, ranked by their first 32 bytes, then by doubling in steps of V until LENGTH bytes are covered.
    cover = np.zeros(V, bool)
    cover[list(COVER)] = True
    samples = np.flatnonzero(cover[np.arange(total) % V])
    clip = lambda x: np.minimum(x, total - 1)
    order = np.lexsort([eight[clip(samples + k)] for k in (24, 16, 8, 0)])
    rank = np.zeros(total, np.int64)

    def number(order: np.ndarray, keys: list[np.ndarray]) -> None:
        same = np.ones(len(order) - 1, bool)
        for key in keys:
            x = key[order]
            same &= x[1:] == x[:-1]
        rank[samples[order]] = np.concatenate([[1], 1 + np.cumsum(~same)])

    number(order, [eight[clip(samples + k)] for k in (0, 8, 16, 24)])
    step = V
    while step < LENGTH:
        key = rank[samples] * (len(samples) + 2) + np.where(samples + step < total, rank[clip(samples + step)], 0)
        number(np.argsort(key, kind="stable"), [key])
        step *= 2
    owner = np.repeat(np.arange(len(texts)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = base[owner] + offset
    d = leads[owner] - offset
    bucket = buckets[owner] * 256 + d
    order = np.lexsort((rank[at + _SHIFT[d]], eight[at + 8], eight[at], bucket))
    a, b = at[order[:-1]], at[order[1:]]
    near = np.flatnonzero(bucket[order[:-1]] == bucket[order[1:]])
    for k in range(0, LENGTH, 8):
        near = near[eight[a[near] + k] == eight[b[near] + k]]
    hit = np.zeros(len(at), bool)
    hit[order[near]] = True
    hit[order[near + 1]] = True
    first = np.ones(len(at), bool)
    first[order[near + 1]] = False
    return hit, first


_PART = pa.schema([("shard", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("offsets", pa.list_(pa.int32())), ("w1", pa.int64()), ("w2", pa.int64())])
_PART_DDL = "shard long, c1 long, c2 long, offsets array<int>, w1 long, w2 long"


def _texts(wanted: DataFrame, folder: str, make, schema: pa.Schema, ddl: str) -> DataFrame:
    """Deal requests by shard, and let make(rows, texts) yield batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        name, column = None, None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(shards[1:] != shards[:-1]) + 1, [len(shards)]])
            for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if shards[first] != name:
                    name = int(shards[first])
                    with files.open_input_file(_path(base, name)) as source:
                        column = pq.read_table(source, columns=["text"], use_threads=False).column("text").combine_chunks()
                        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
                own = batch.slice(first, end - first)
                ends = np.frombuffer(column.buffers()[1], np.int64)
                raw = column.buffers()[2]
                begin = ends[own.column("row").to_numpy()] + own.column("lo").to_numpy()
                size = own.column("size").to_numpy() + LENGTH
                yield make(own, [raw.slice(int(s), int(n)).to_pybytes() for s, n in zip(begin, size, strict=True)])

    rows = wanted.select("block", "owner", "c1", "c2", "shard", "row", "lo", "size", "lead", "whole").repartition(partitions(wanted.sparkSession), "shard").sortWithinPartitions("shard", "row")
    return rows.mapInArrow(run, ddl)


def sort_blocks(planned: DataFrame, folder: str) -> DataFrame:
    """Per content that isn't repeated as a whole, the offsets of its windows that its block repeats; and, with w1 and w2, a row for each distinct window of a block's share of a cut bucket, whose offset is given if the block has it once."""
    schema = pa.schema([*((c, pa.int64()) for c in ("block", "owner", "c1", "c2", "shard", "size", "lead")), ("whole", pa.bool_()), ("text", pa.binary())])
    take = lambda own, got: pa.RecordBatch.from_arrays([*(own.column(c) for c in schema.names[:-1]), pa.array(got, pa.binary())], schema=schema)
    wanted = planned.where("block is not null")
    found = _texts(wanted.where("c1 is not null"), folder, take, schema, "block long, owner long, c1 long, c2 long, shard long, size long, lead long, whole boolean, text binary")
    found = found.unionByName(wanted.where("c1 is null").select("block", "owner"), allowMissingColumns=True)

    def sort(rows: pa.Table, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        owners, whole = rows["owner"].to_numpy(), rows["whole"].to_numpy(zero_copy_only=False)
        buckets = np.cumsum(np.concatenate([[0], owners[1:] != owners[:-1]]))
        texts, count = rows["text"].to_pylist(), rows["size"].to_numpy() + 1
        hit, first = repeated_windows(texts, rows["lead"].to_numpy(), count, buckets)
        start = np.cumsum(count) - count
        names = [rows[c].to_numpy() for c in ("shard", "c1", "c2")]
        some = np.flatnonzero(~whole & np.logical_or.reduceat(hit, start))
        offsets = [np.flatnonzero(hit[start[k] : start[k] + count[k]]).astype(np.int32) for k in some.tolist()]
        empty = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(c[some]) for c in names), pa.array(offsets, pa.list_(pa.int32())), empty, empty], schema=_PART)
        of = np.repeat(np.arange(len(count)), count)
        edge = np.flatnonzero(first & np.isin(owners, cut)[of])
        if len(edge):
            length = count + LENGTH - 1
            at = (np.cumsum(length) - length)[of[edge]] + edge - start[of[edge]]
            windows = digests(b"".join(texts), at, at + LENGTH)
            alone = ~hit[edge] & ~whole[of[edge]]
            single = pa.ListArray.from_arrays(np.arange(len(edge) + 1, dtype=np.int32), pa.array((edge - start[of[edge]]).astype(np.int32)))
            single = pc.if_else(pa.array(alone), single, None)
            yield pa.RecordBatch.from_arrays([*(pa.array(c[of[edge]]) for c in names), single, pa.array(windows[:, 0]), pa.array(windows[:, 1])], schema=_PART)

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Sort a block, a few buckets at a time."""
        cut = rows.filter(rows["c1"].is_null())["owner"].to_numpy()
        rows = rows.filter(rows["c1"].is_valid())
        owners = rows["owner"].to_numpy()
        ends = np.concatenate([np.flatnonzero(owners[1:] != owners[:-1]) + 1, [len(owners)]])
        upto = np.cumsum(rows["size"].to_numpy() + LENGTH)
        first = 0
        while first < len(owners):
            room = upto[first - 1] + BLOCK_BYTES if first else BLOCK_BYTES
            fits = ends[(ends > first) & (upto[ends - 1] <= room)]
            end = int(fits[-1] if len(fits) else ends[ends > first][0])
            yield from sort(rows.slice(first, end - first), cut)
            first = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block = None
        for batch in batches:
            names = batch.column("block").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]])
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if held and names[start] != block:
                    yield from flush(pa.Table.from_batches(held))
                    held = []
                block = names[start]
                held.append(batch.slice(start, end - start))
        if held:
            yield from flush(pa.Table.from_batches(held))

    return found.repartition(partitions(planned.sparkSession), "block").sortWithinPartitions("block", "owner", "c1", "c2").mapInArrow(run, _PART_DDL)


def cut_text(text: bytes, windows: np.ndarray) -> tuple[int, int, bytes]:
    """Removed bytes, removed runs and what stays; windows are rows (first start, last start)."""
    if not len(windows):
        return 0, 0, text
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, windows[:, 0], 1)
    np.add.at(edge, windows[:, 1] + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def inside(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which rows (two numbers) of x are among keys, which are sorted."""
    found, at, live = np.zeros(len(x), bool), np.searchsorted(keys[:, 0], x[:, 0]), np.arange(len(x))
    while len(live):
        live = live[at[live] < len(keys)]
        live = live[keys[at[live], 0] == x[live, 0]]
        same = keys[at[live], 1] == x[live, 1]
        found[live[same]] = True
        live = live[~same]
        at[live] += 1
    return found


def finish(shards: DataFrame, results: DataFrame, folder: str, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the kept bytes. results: contents of a shard with the offsets of repeated windows, null for all."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        shard: int | None = None
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            rows = rows.filter(rows["c1"].is_valid())
            keys = np.column_stack([rows["c1"].to_numpy(), rows["c2"].to_numpy()])
            whole = rows["offsets"].is_null().to_numpy()
            part: dict[tuple[int, int], list[np.ndarray]] = {}
            for (a, b), o in zip(keys[~whole].tolist(), rows["offsets"].filter(pa.array(~whole)).to_pylist(), strict=True):
                part.setdefault((a, b), []).append(np.array(o, np.int64))
            full, some = keys[whole], np.array(list(part), np.int64).reshape(-1, 2)
            full, some = (k[np.lexsort((k[:, 1], k[:, 0]))] for k in (full, some))
            with files.open_input_file(_path(base, shard)) as source:
                docs = pq.read_table(source, use_threads=False)
            for chunk in docs.to_batches(max_chunksize=500):
                packed = chunk.column("stretches").to_pylist()
                own = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 4)
                of = np.repeat(np.arange(len(packed)), [len(x) // 32 for x in packed])
                every = np.flatnonzero(inside(full, own[:, 2:]))
                found: dict[int, list[np.ndarray]] = {}
                cuts = np.flatnonzero(np.diff(of[every])) + 1
                for rows_of in np.split(every, cuts) if len(every) else ():
                    found[int(of[rows_of[0]])] = [own[rows_of, :2]]
                for k in np.flatnonzero(inside(some, own[:, 2:])).tolist():
                    for got in part[int(own[k, 2]), int(own[k, 3])]:
                        at = own[k, 0] + got
                        found.setdefault(int(of[k]), []).append(np.column_stack([at, at]))
                out = []
                for k, (doc, text) in enumerate(zip(chunk.column("doc_id").to_pylist(), chunk.column("text").to_pylist(), strict=True)):
                    removed, runs, kept = cut_text(text, np.concatenate(found[k])) if k in found else (0, 0, text)
                    out.append((doc, len(text), removed, runs, hashlib.sha256(kept).hexdigest(), *([kept] * with_text)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            names = batch.column("shard").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]])
            for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if held and names[first] != shard:
                    yield from flush()
                    held = []
                shard = int(names[first])
                held.append(batch.slice(first, end - first))
        if held:
            yield from flush()

    none = F.lit(None)
    rows = shards.select("shard", none.cast("long").alias("c1"), none.cast("long").alias("c2"), none.cast("array<int>").alias("offsets")).unionByName(results)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return rows.repartition(partitions(shards.sparkSession), "shard").sortWithinPartitions("shard").mapInArrow(run, ddl)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document what is removed and kept."""
    spark = docs.sparkSession
    arrow_limits(spark)
    folder = scratch(spark, "shards")
    found = materialize(index(docs, folder), "stretches")
    arrow_limits(spark, 4000)
    planned = materialize(plan_blocks(found), "block-plan")
    parts = materialize(sort_blocks(join_borders(planned), folder), "blocks")
    windows = parts.where("w1 is not null")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    across = windows.where("offsets is not null").join(twice, ["w1", "w2"]).select("shard", "c1", "c2", "offsets")
    results = planned.where("whole").select("shard", "c1", "c2", F.lit(None).cast("array<int>").alias("offsets"))
    results = results.unionByName(parts.where("w1 is null").select("shard", "c1", "c2", "offsets")).unionByName(across)
    return finish(found.where("owner is null").select("shard"), results, folder, with_text)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, j, substr(x, 2000 * j + 1, 2000 + 2 * {LENGTH} - 2) AS y
      FROM (SELECT doc_id, x, unnest(generate_series(0, (len(x) // 2 - {LENGTH}) // 1000)) AS j FROM h WHERE len(x) >= 2 * {LENGTH})),
w AS (SELECT doc_id, 1000 * j + i AS p, md5(substr(y, 2 * i + 1, 2 * {LENGTH})) AS m FROM (SELECT doc_id, j, y, unnest(generate_series(0, len(y) // 2 - {LENGTH})) AS i FROM c)),
r AS (SELECT doc_id, p FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
g AS (SELECT doc_id, p, sum(CASE WHEN p <= q + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS z FROM g GROUP BY doc_id, k),
e AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_removed, max(z) AS z FROM s GROUP BY doc_id),
o AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM s UNION ALL SELECT doc_id, coalesce(z, 0), len(x) // 2 FROM h LEFT JOIN e USING (doc_id)),
t AS (SELECT doc_id, sha256(unhex(string_agg(substr(x, 2 * a + 1, 2 * (z - a)), '' ORDER BY a))) AS kept_sha256 FROM o JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256 FROM h JOIN t USING (doc_id) LEFT JOIN e USING (doc_id)
"""
