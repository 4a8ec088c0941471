"""Token-ID output as directly addressable codes (DACs).

Each id is split into 8-bit chunks, least significant first. Level 0 holds the first chunk of every id; a
continuation bitmap tells which ids go on, and level 1 holds the next chunk of just those, and so on. A rank
directory over each bitmap turns a position of one level into a position of the next, so any token or range is read
without decoding a block.

A file: magic, number of levels and tokens, a table of section offsets, then per level chunk bytes, bitmap words and
rank directory (ones before every 512 bits).

Defined results: a null text is the empty text and yields the end id alone; rows are written by ascending doc_id, null
first, ties by text; repeated rows are separate documents; other columns are ignored. A text of any length is
encoded whole. An empty table yields no file.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkmill.llm.common import arrow_limits, materialize, partitions, read_file, scratch, table, use_cache, write_file

MAGIC = b"DACTOK01"
BITS, BLOCK = 8, 512
#: Tokens after which a task starts the next file.
FILE_TOKENS = 4_000_000
#: Distinct pieces that a worker remembers.
CACHE_PIECES = 250_000
END_ID = 2


def encode(ids: np.ndarray) -> bytes:
    """The file image of an array of unsigned ids."""
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        chunk = (rest & np.uint32(0xFF)).astype(np.uint8)
        more = rest > np.uint32(0xFF)
        levels.append((chunk, more))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(BITS)
    head, parts, at = [], [], 0
    base = len(MAGIC) + 4 + 8 + len(levels) * 32
    for chunk, more in levels:
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        sections = [chunk.tobytes(), bits.tobytes(), ranks.tobytes()]
        offsets = []
        for s in sections:
            offsets.append(base + at)
            parts.append(s)
            at += len(s)
        head.append(struct.pack("<4Q", len(chunk), *offsets))
    return b"".join([MAGIC, struct.pack("<IQ", len(levels), len(levels[0][0])), *head, *parts])


class Reader:
    """Random access: token(i) follows one chunk per level, slice(i, j) one range per level.

    source is a file image, or a function of (offset, length) that reads a range; then the header is read once and each
    access reads a few short ranges of each level.
    """

    def __init__(self, source: bytes | Callable[[int, int], bytes]):
        self.read = (lambda at, n: source[at : at + n]) if isinstance(source, bytes) else source
        head = self.read(0, len(MAGIC) + 12)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        n, self.size = struct.unpack_from("<IQ", head, len(MAGIC))
        table = self.read(len(head), 32 * n)
        self.levels = [struct.unpack_from("<4Q", table, 32 * k) for k in range(n)]

    def rank(self, level: int, i: int) -> int:
        """Ones in the level's bitmap before i."""
        _, _, bits, ranks = self.levels[level]
        block = i // BLOCK
        (before,) = struct.unpack("<Q", self.read(ranks + 8 * block, 8))
        left = i - block * BLOCK
        if not left:
            return before
        part = int.from_bytes(self.read(bits + block * BLOCK // 8, (left + 7) // 8), "little")
        return before + (part & ((1 << left) - 1)).bit_count()

    def token(self, i: int) -> int:
        value = 0
        for level, (_, chunks, bits, _) in enumerate(self.levels):
            value |= self.read(chunks + i, 1)[0] << (BITS * level)
            if not self.read(bits + i // 8, 1)[0] >> (i % 8) & 1:
                break
            i = self.rank(level, i)
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids of start..end-1: those that go on lie next to one another on the next level."""
        out = None
        where: np.ndarray | None = None
        for level, (_, chunks, bits, _) in enumerate(self.levels):
            got = np.frombuffer(self.read(chunks + start, end - start), np.uint8).astype(np.uint32) << np.uint32(BITS * level)
            if out is None:
                out, where = got, np.arange(end - start)
            else:
                out[where] |= got
            first = start // 8
            raw = np.frombuffer(self.read(bits + first, (end + 7) // 8 - first), np.uint8)
            more = np.unpackbits(raw, bitorder="little")[start - 8 * first : end - 8 * first].astype(bool)
            if not more.any():
                break
            where = where[more]
            start = self.rank(level, start)
            end = start + int(more.sum())
        return out


def open_tokens(uri: str) -> Reader:
    """A reader of a token file that reads only the ranges it needs."""
    return Reader(lambda at, n: read_file(uri, at, n))


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the other bytes, in order, for U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


# White space beyond ASCII by its UTF-8 lead byte; the second and third bytes that make it.
_SPACES = {
    0xC2: {b"\x85", b"\xa0"}, 0xE1: {b"\x9a\x80", b"\xa0\x8e"}, 0xE3: {b"\x80\x80"},
    0xE2: {b"\x80" + bytes([c]) for c in (*range(0x80, 0x8C), 0xA8, 0xA9, 0xAF)} | {b"\x81\x9f"},
}
# Letters of one byte, and of two bytes in blocks that hold almost nothing else (the two marks are left out).
LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5\xd0\xd1][\x80-\xbf])+")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_LEAD = np.zeros(256, bool)
_LEAD[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = True
#: Bytes of texts that are cut and looked up at a time.
PASS_BYTES = 8 << 20


def cuts(data: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Positions before which a byte-level pre-tokenizer always breaks, whatever stands around: before a space or line feed
    that something visible follows in the same text, after such a line feed, and between a letter and an ASCII mark. Texts
    end at stop."""
    here, after = data[:-1], data[1:]
    visible = after > 32
    visible[stop[(stop > 0) & (stop < len(data))] - 1] = False
    space = np.flatnonzero(((here == 32) | (here == 10)) & visible)
    high = space[data[space + 1] >= 0x80]
    if len(high):
        wide = np.concatenate([data, np.zeros(3, np.uint8)])
        odd = np.zeros(len(high), bool)
        for lead, rest in _SPACES.items():
            at = np.flatnonzero(wide[high + 1] == lead)
            for tail in rest:
                same = np.ones(len(at), bool)
                for k, c in enumerate(tail):
                    same &= wide[high[at] + 2 + k] == c
                odd[at[same]] = True
        space = np.setdiff1d(space, high[odd], assume_unique=True)
    feed = space[data[space] == 10]
    mark = np.flatnonzero(_MARK[after] & ((here >= 0x80) | _LETTER[here]))
    high = data[mark] >= 0x80
    before = data[np.maximum(mark, 1) - 1]
    mark = mark[~high | (_LEAD[before] & ~((before == 0xC3) & ((data[mark] == 0x97) | (data[mark] == 0xB7))))]
    return np.concatenate([space, feed + 1, mark + 1])


class PieceEncoder:
    """The tokenizer with a memory of pieces.

    A batch of texts is one byte array. It is cut where the pre-tokenizer breaks in any case, so a piece's ids don't depend
    on its neighbours; distinct pieces are found by Arrow, the tokenizer sees those that are new, and the ids of all pieces
    are gathered by position. Nothing is done in Python for each piece of a text. Texts that hold a special token's string
    are encoded whole, and so is every text where the tokenizer isn't a plain byte-level one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as source:
            told = json.load(source)
        before = told.get("pre_tokenizer") or {}
        self.plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not told.get("normalizer") and not told["model"].get("dropout")
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.count, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _shrink(self) -> None:
        """Keep the pieces that several passes have used, at most half of what may be held."""
        uses = self.uses[: len(self.place)]
        kept = np.flatnonzero(uses > 1)
        if len(kept) > CACHE_PIECES // 2:
            kept = np.sort(kept[np.argsort(-uses[kept], kind="stable")[: CACHE_PIECES // 2]])
        names, first, count, used, ids = list(self.place), self.first[kept], self.count[kept], uses[kept] // 2, self.ids
        self._forget()
        self._make_room(len(kept), int(count.sum()))
        ends = np.cumsum(count)
        self.used = int(count.sum())
        self.ids[: self.used] = ids[np.repeat(first - (ends - count), count) + np.arange(self.used)]
        self.first[: len(kept)], self.count[: len(kept)], self.uses[: len(kept)] = ends - count, count, used
        self.place = {names[k]: i for i, k in enumerate(kept.tolist())}

    def _make_room(self, pieces: int, ids: int) -> None:
        while pieces > len(self.first):
            self.first, self.count, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.uses))
        while self.used + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])

    def _encode(self, strings: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([s.decode("utf-8", "surrogatepass") for s in strings], add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        for k in range(0, len(pieces), 4096):
            part = pieces[k : k + 4096]
            found: list[list[int]] = [[]] * len(part)
            rest = []
            plain, tokenize, letters, space = self.plain, self.tokenize, self.letters, self.letters[32]
            for i, piece in enumerate(part):  # a piece of letters is one pre-token: the model alone
                if plain and piece[:1] == b" " and piece[1:].isalpha():
                    found[i] = [t.id for t in tokenize(space + piece[1:].decode())]
                elif plain and LETTERS.fullmatch(piece):
                    found[i] = [t.id for t in tokenize(piece.decode("latin-1").translate(letters))]
                else:
                    rest.append(i)
            for i, ids in zip(rest, self._encode([part[i] for i in rest]), strict=True):
                found[i] = ids
            n = np.array([len(f) for f in found])
            known, total = len(self.place), int(n.sum())
            self._make_room(known + len(part), total)
            self.first[known : known + len(part)] = self.used + np.cumsum(n) - n
            self.count[known : known + len(part)] = n
            self.ids[self.used : self.used + total] = [i for f in found for i in f]
            self.used += total
            self.place.update(zip(part, range(known, known + len(part)), strict=True))

    def encode(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, each with the end id, and how many each text has."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        stop = np.cumsum(size)
        whole = [k for k, t in enumerate(texts) if not self.plain or any(s in t for s in self.special)]
        is_start = np.zeros(len(data), bool)
        is_start[(stop - size)[size > 0]] = True
        if len(data) > 1:
            is_start[cuts(data, stop)] = True
        start = np.flatnonzero(is_start)
        if whole:
            inside = np.isin(np.searchsorted(stop, start, side="right"), whole)
            start = start[~inside | np.isin(start, stop - size)]
        if len(self.place) > CACHE_PIECES:
            self._shrink()
        bounds = np.concatenate([start, [len(data)]]).astype(np.int64 if len(data) >> 31 else np.int32)
        kind = pa.LargeBinaryArray if len(data) >> 31 else pa.BinaryArray
        found = kind.from_buffers(pa.large_binary() if len(data) >> 31 else pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        pieces = found.dictionary.to_pylist()
        self._learn([p for p in pieces if p not in self.place])
        known = np.array([self.place[p] for p in pieces], np.int64)
        self.uses[known] += 1
        which = known[found.indices.to_numpy()] if len(start) else known
        count, first = self.count[which], self.first[which]
        ends = np.cumsum(count)
        tokens = self.ids[np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.searchsorted(start, stop)]
        each = np.diff(np.concatenate([[0], upto]))
        if end is None:
            return tokens, each
        return np.insert(tokens, upto, end), each + 1


_encoders: dict[str, PieceEncoder] = {}


def forget() -> None:
    """Drop what this worker keeps; a function, so that tasks reach the module's own memory."""
    _encoders.clear()


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def passes(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """doc_ids and texts of about most bytes at a time."""
    ids: list[int | None] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            ids.append(doc)
            texts.append(text or b"")
            size += len(texts[-1])
            if size >= (PASS_BYTES if most is None else most):
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the ids of docs.text in doc_id order. Returns the directory: doc_id, part, file_no, file, local_start, n_tokens.

    Range partitions by doc_id keep the order across files; each attempt of a task has file names of its own, and the
    committed directory names those of the attempts that count.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    folder = scratch(spark, "tokens")
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("file_no", pa.int64()), ("file", pa.string()), ("local_start", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        use_cache("tokens", forget)
        part, attempt, number = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        coder = encoder(tokenizer)
        docs_held: list[int | None] = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            name = f"{folder}/part-{part:06d}-{number:06d}-{attempt}.dac"
            write_file(name, encode(np.concatenate(held)))
            n = np.concatenate(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array(docs_held, pa.int64()), pa.array(np.full(len(n), part)), pa.array(np.full(len(n), number)), pa.array([name] * len(n)), pa.array(np.cumsum(n) - n), pa.array(n)], schema=schema
            )

        for ids, texts in passes(batches):
            got, n = coder.encode(texts, end_id)
            stop = np.cumsum(n)
            first = done = 0
            while first < len(ids):  # a file ends with the document that fills it
                last = min(len(ids), int(np.searchsorted(stop, done + file_tokens - tokens)) + 1)
                docs_held += ids[first:last]
                counts.append(n[first:last])
                held.append(got[done : int(stop[last - 1])].copy())
                tokens += int(stop[last - 1]) - done
                first, done = last, int(stop[last - 1])
                if tokens >= file_tokens:
                    yield flush()
                    docs_held, counts, held, tokens, number = [], [], [], 0, number + 1
        if docs_held:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialize(ordered.mapInArrow(write, "doc_id long, part long, file_no long, file string, local_start long, n_tokens long"), "token-directory")


def with_starts(directory: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before: sums over files in groups of a part, then over parts in groups of 1000."""
    files = directory.groupBy("part", "file_no").agg(F.sum("n_tokens").alias("n"))
    parts = files.groupBy("part").agg(F.sum("n").alias("part_n")).withColumn("span", F.floor(F.col("part") / 1000))
    spans = parts.groupBy("span").agg(F.sum("part_n").alias("span_n"))
    before = lambda n, *order: F.coalesce(F.sum(n).over(W.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("span", before("span_n", "span").alias("span_start"))
    parts = parts.select("part", "span", before("part_n", "span", "part").alias("in_span")).join(spans, "span")
    files = files.select("part", "file_no", before("n", "part", "file_no").alias("in_part")).join(parts, "part")
    files = files.select("part", "file_no", (F.col("span_start") + F.col("in_span") + F.col("in_part")).alias("file_start"))
    return directory.join(files, ["part", "file_no"]).withColumn("start", F.col("file_start") + F.col("local_start")).drop("file_start")


def read_back(directory: DataFrame) -> DataFrame:
    """Per directory row, from the files: doc_id, start, n_tokens and the crc32 of its ids as little-endian 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            sums = []
            for file, start, n in zip(batch.column("file").to_pylist(), batch.column("local_start").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                if file != name:
                    name, reader = file, Reader(read_file(file))
                sums.append(zlib.crc32(reader.slice(start, start + n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], schema=schema)

    spark = directory.sparkSession
    placed = with_starts(directory).select("doc_id", "file", "local_start", "start", "n_tokens").repartition(partitions(spark), "file").sortWithinPartitions("file", "local_start")
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(write_tokens(table(spark, sf_dir, "documents"), tokenizer_path()))
